"""The normal distribution: once as column expressions, once on floats and arrays."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile (Acklam), numerators and denominators by falling power.
CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
# The normal integral (Abramowitz and Stegun 26.2.17), by rising power of 1 / (1 + STRETCH |x|).
STRETCH = 0.2316419
INTEGRAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _horner(coefficients, x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def probit(p: float) -> float:
    """Quantile of the standard normal distribution; NaN outside [0, 1]."""
    if not 0.0 <= p <= 1.0:
        return math.nan
    if p in (0.0, 1.0):
        return -math.inf if p == 0.0 else math.inf
    if TAIL <= p <= 1.0 - TAIL:
        q = p - 0.5
        return _horner(CENTRE_NUM, q * q) * q / _horner(CENTRE_DEN, q * q)
    q = math.sqrt(-2.0 * math.log(min(p, 1.0 - p)))
    return math.copysign(1.0, 0.5 - p) * _horner(TAIL_NUM, q) / _horner(TAIL_DEN, q)


def cdf(x):
    """Normal integral of a float or array; the limits at infinities."""
    x = np.asarray(x, float)
    size = np.abs(np.where(np.isfinite(x), x, 40.0))
    t = 1.0 / (1.0 + STRETCH * size)
    above = np.exp(-0.5 * size * size) / math.sqrt(2 * math.pi) * t * _horner(INTEGRAL[::-1], t)
    return np.where(x >= 0, 1.0 - above, above)


def cdf_column(x: Column) -> Column:
    """Normal integral as an expression: it stays inside code generation."""
    size = F.abs(x)
    t = 1.0 / (1.0 + STRETCH * size)
    above = F.exp(-0.5 * size * size) / math.sqrt(2 * math.pi) * t * _horner(INTEGRAL[::-1], t)
    return F.when(x >= 0, 1.0 - above).otherwise(above)


def cdf_sql(x: str) -> str:
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {STRETCH}::DOUBLE * abs({x})))"
    poly = f"{INTEGRAL[4]!r}::DOUBLE"
    for c in INTEGRAL[3::-1]:
        poly = f"({poly} * {t} + ({c!r})::DOUBLE)"
    above = f"(exp(-0.5::DOUBLE * ({x}) * ({x})) / sqrt(2 * pi()) * {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1.0::DOUBLE - {above} ELSE {above} END)"
