"""Operators on single rows: expressions where Catalyst has them, vectorised functions where it has not."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normal import cdf, cdf_column
from . import numerics as nx


def bs_price(spot: Column, strike: Column, ttm: Column, rate: Column, sigma: Column, is_call: Column | None = None) -> Column:
    """Black-Scholes price; without time or volatility the payoff, undiscounted."""
    call = F.lit(True) if is_call is None else is_call
    live = (ttm > 0) & (sigma > 0)
    t, s = F.when(live, ttm), F.when(live, sigma)
    d1 = (F.ln(spot / strike) + (rate + s * s / 2.0) * t) / (s * F.sqrt(t))
    d2 = d1 - s * F.sqrt(t)
    side = F.when(call, 1.0).otherwise(-1.0)
    priced = side * (spot * cdf_column(side * d1) - strike * F.exp(-rate * t) * cdf_column(side * d2))
    return F.when(live, priced).otherwise(F.greatest(side * (spot - strike), F.lit(0.0)))


def _price(spot, strike, ttm, rate, sigma, side):
    d1 = (np.log(spot / strike) + (rate + sigma**2 / 2) * ttm) / (sigma * np.sqrt(ttm))
    d2 = d1 - sigma * np.sqrt(ttm)
    vega = spot * np.sqrt(ttm) * np.exp(-0.5 * d1**2) / math.sqrt(2 * math.pi)
    return side * (spot * cdf(side * d1) - strike * np.exp(-rate * ttm) * cdf(side * d2)), vega


def implied(price, spot, strike, ttm, rate, side) -> np.ndarray:
    """Volatilities by Newton steps inside a bracket, halved where a step would leave it; NaN where none fits."""
    price, spot, strike, ttm, rate, side = (np.asarray(v, float) for v in (price, spot, strike, ttm, rate, side))
    fine = (price > 0) & (spot > 0) & (strike > 0) & (ttm > 0)
    price, spot, strike, ttm = (np.where(fine, v, 1.0) for v in (price, spot, strike, ttm))
    sigma = np.sqrt(2 * np.abs(np.log(spot / strike) + rate * ttm) / ttm)
    sigma = np.where(np.isfinite(sigma) & (sigma > 0), sigma, 0.2)
    low, high, done = np.full_like(sigma, 1e-6), np.full_like(sigma, 10.0), np.zeros(sigma.shape, bool)
    for _ in range(100):
        value, vega = _price(spot, strike, ttm, rate, sigma, side)
        gap = value - price
        done |= np.abs(gap) < 1e-8
        if done.all():
            break
        high, low = np.where(gap > 0, sigma, high), np.where(gap > 0, low, sigma)
        step = sigma - gap / np.where(vega < 1e-8, 1.0, vega)
        inside = (vega >= 1e-8) & (step > low) & (step < high)
        sigma = np.where(done, sigma, np.where(inside, step, (low + high) / 2))
    near = np.abs(_price(spot, strike, ttm, rate, sigma, side)[0] - price) < 1e-4
    return np.where(fine & (done | near), sigma, np.nan)


def ImpliedVolatility(price: Column, spot: Column, strike: Column, ttm: Column, rate: Column | None = None, is_call: Column | None = None) -> Column:
    @F.pandas_udf(T.DoubleType())
    def solve(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = implied(p, s, k, t, r, np.where(c, 1.0, -1.0))
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return solve(price, spot, strike, ttm, F.lit(0.0) if rate is None else rate, F.lit(True) if is_call is None else is_call)


TERM = T.StructType([T.StructField(n, T.DoubleType()) for n in ("slope", "curvature", "contango")])


def VixTermStructure(spot_vix: Column, futures: Column, maturities: Column) -> Column:
    """Quadratic through futures by maturity (ridge 1e-9): slope and curvature at zero, and the nearest future over spot."""

    @F.pandas_udf(TERM)
    def fit(spot: pd.Series, prices: pd.Series, times: pd.Series) -> pd.DataFrame:
        rows = []
        for s, p, t in zip(spot, prices, times, strict=True):
            if p is None or t is None or len(p) != len(t) or len(p) < 2:
                rows.append((None, None, None))
                continue
            basis = np.vander(np.asarray(t, float), 3, increasing=True)
            c = nx.solve(basis.T @ basis + 1e-9 * np.eye(3), basis.T @ np.asarray(p, float))
            near = p[int(np.argmin(t))]
            rows.append((None, None, None) if c is None else (c[1], 2 * c[2], (near - s) / s if abs(s) > 1e-12 else 0.0))
        return pd.DataFrame(rows, columns=TERM.names)

    return fit(spot_vix, futures, maturities)


def risk_parity(c: np.ndarray, iters: int = 200) -> np.ndarray:
    w = 1 / np.sqrt(np.maximum(np.diag(c), 1e-18))
    w = w / w.sum()
    for _ in range(iters):
        risk = w * (c @ w)
        w = w * np.clip(risk.mean() / np.maximum(np.abs(risk), 1e-18), 0.1, 10.0)
        w = np.where(w < 0, 1e-6, w)
        w = w / w.sum() if abs(w.sum()) > 0 else w
    return w


def risk_parity_weights(covariance: Column, n_assets: int, iters: int = 200) -> Column:
    """Weights of equal risk contribution for a row-major covariance."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def weigh(c: pd.Series) -> pd.Series:
        return c.map(lambda v: None if v is None or len(v) != n_assets**2 else risk_parity(np.asarray(v, float).reshape(n_assets, n_assets), iters).tolist())

    return weigh(covariance)


def levinson_durbin(acf: Column, order: int) -> Column:
    kind = T.StructType([T.StructField("ar", T.ArrayType(T.DoubleType())), T.StructField("error_variance", T.DoubleType()), T.StructField("reflection", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def solve(rows: pd.Series) -> pd.DataFrame:
        out = [nx.levinson(np.asarray(v, float), order) if v is not None else None for v in rows]
        return pd.DataFrame([(None, None, None) if o is None else (o[0][0].tolist(), float(o[1][0]), o[2][0].tolist()) for o in out], columns=kind.names)

    return solve(acf)


def burg_ar(data: Column, order: int) -> Column:
    kind = T.StructType([T.StructField("ar", T.ArrayType(T.DoubleType())), T.StructField("reflection", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def solve(rows: pd.Series) -> pd.DataFrame:
        out = [nx.burg(np.asarray(v, float), order) if v is not None else None for v in rows]
        return pd.DataFrame([(None, None) if o is None else (o[0][0].tolist(), o[1][0].tolist()) for o in out], columns=kind.names)

    return solve(data)


ALL = {g.__name__: g for g in (bs_price, ImpliedVolatility, VixTermStructure, risk_parity_weights, levinson_durbin, burg_ar)}
