"""Tail risk, realized variance and portfolio weights of the last rows, on a cadence."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa

from ..functions.normal import CENTRE_DEN, CENTRE_NUM, TAIL, _horner
from ..plans.ordered import Frame
from . import numerics as nx
from .recursive import least_variance
from .rolling import between, positive
from .spectral import DOUBLES


class EntropicVaR(Frame):
    """Minus the least of (ln mean e^(zx) - ln z) / ln(1 / alpha) over z = 0.01, 0.02, ..., 0.99."""

    def __init__(self, window: int = 64, alpha: float = 0.01, update_every: int = 16):
        super().__init__(positive("window", window), update_every)
        self.alpha = between("alpha", alpha, 0, 1)

    def compute(self, own: Any, x: np.ndarray) -> list:
        best = np.full(len(x), np.inf)
        for z in np.arange(1, 100) * 0.01:
            with np.errstate(over="ignore"):
                value = (np.log(np.exp(z * x).mean(axis=1)) - math.log(z)) / math.log(1 / self.alpha)
            best = np.where(np.isfinite(value) & (value < best), value, best)
        return np.where(np.isfinite(best), -best, np.quantile(x, self.alpha, axis=1)).tolist()


class EVTGpdTailRisk(Frame):
    """Generalised Pareto fit, by moments, to what exceeds a quantile of the window's upper tail."""

    type = pa.struct([("var", pa.float64()), ("expected_shortfall", pa.float64()), ("shape", pa.float64()), ("scale", pa.float64()), ("n_exceedances", pa.int32())])

    def __init__(self, window: int = 128, alpha: float = 0.01, threshold_quantile: float = 0.95, update_every: int = 32):
        super().__init__(positive("window", window), update_every)
        self.alpha, self.q = between("alpha", alpha, 0, 1), between("threshold_quantile", threshold_quantile, 0, 1)

    def one(self, x: np.ndarray) -> dict:
        n, s = len(x), np.sort(x)
        level = s[min(int(n * self.q), n - 1)]
        over = s[s >= level] - level
        if len(over) < 5:
            k = math.ceil(n * self.alpha)
            return {"var": abs(float(np.quantile(s, self.alpha))), "expected_shortfall": abs(float(s[: max(k, 1)].mean())), "shape": 0.0, "scale": 0.0, "n_exceedances": 0}
        mean = float(over.mean())
        spread = float((over**2).mean()) - mean**2
        shape = 0.5 * (1 - mean**2 / spread) if spread > 1e-30 else 0.0
        scale = mean * (1 + shape)
        ratio = max(n / len(over) * (1 - self.alpha), 1e-10)
        var = level + (scale / shape * (ratio**-shape - 1) if abs(shape) > 1e-6 else -scale * math.log(ratio))
        es = (var + scale - shape * level) / (1 - shape) if shape < 1 and abs(1 - shape) > 1e-6 else var
        return {"var": abs(float(var)), "expected_shortfall": abs(float(es)), "shape": shape, "scale": scale, "n_exceedances": len(over)}

    def compute(self, own: Any, x: np.ndarray) -> list:
        return [self.one(v) for v in x]


def coarse_quantile(p: float) -> float:
    """A normal quantile that is right only between the tails; within them it is the bare leading term, its sign turned."""
    if TAIL <= p <= 1 - TAIL:
        q = p - 0.5
        return q * _horner(CENTRE_NUM, q * q) / _horner(CENTRE_DEN, q * q)
    return math.sqrt(-2 * math.log(p)) if p < TAIL else -math.sqrt(-2 * math.log(1 - p))


class JohnsonSUVaR(Frame):
    """Quantile of a Johnson SU shape set from the window's moments."""

    def __init__(self, window: int = 64, alpha: float = 0.01, update_every: int = 16):
        super().__init__(positive("window", window), update_every)
        self.z = coarse_quantile(between("alpha", alpha, 0, 1))

    def compute(self, own: Any, x: np.ndarray) -> list:
        mean = x.mean(axis=1)
        d = x - mean[:, None]
        m2, m3, m4 = ((d**k).mean(axis=1) for k in (2, 3, 4))
        some = m2 > 1e-30
        safe = np.where(some, m2, 1.0)
        skew, kurt = np.where(some, m3 / safe**1.5, 0.0), np.where(some, m4 / safe**2, 3.0)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            omega = np.sqrt(4 + 2 * (kurt - skew**2 - 1))
            gamma = -np.copysign(0.5, skew) * np.sqrt((omega - 1) / (omega + 1))
            # a root below zero is not a number, and the larger of that and 0.1 is 0.1
            delta = 1 / np.fmax(np.sqrt(np.log(np.maximum(omega - 1, 0.1))), 0.1)
            place = mean - np.sqrt(omega - 1) * gamma / delta
            size = np.sqrt(m2) / np.sqrt((omega - 1) * (np.cosh(omega) - 1))
            return (-(place + size * np.sinh((self.z - gamma) / delta))).tolist()


class SpectralRiskMeasure(Frame):
    """Mean of absolute values in rising order of the values, under exponentially rising weights."""

    def __init__(self, window: int = 64, gamma: float = 0.05, update_every: int = 16):
        super().__init__(positive("window", window), update_every)
        if gamma <= 0:
            raise ValueError("gamma must be positive")
        u = np.arange(1, self.window + 1) / self.window
        w = np.exp(-gamma * (1 - u))
        self.weights = w / w.sum()

    def compute(self, own: Any, x: np.ndarray) -> list:
        return (np.abs(np.sort(x, axis=1)) @ self.weights).tolist()


class RealizedKernel(Frame):
    """Parzen-weighted autocovariances, annualised and not negative."""

    def __init__(self, window: int = 64, n_lags: int = 10, annualization: float = 252.0, update_every: int = 16):
        super().__init__(positive("window", window), update_every)
        self.lags, self.year = min(positive("n_lags", n_lags), window // 2), annualization

    def compute(self, own: Any, x: np.ndarray) -> list:
        h = np.arange(self.lags + 1)
        weights = np.where(h == 0, 1.0, 2 * nx.parzen(h / (self.lags + 1.0)))
        return (np.maximum(nx.autocorrelation(x, self.lags) @ weights, 0.0) * self.year).tolist()


class TwoScaleRealizedVariance(Frame):
    """Mean squared moves of k interleaved subsamples, less a k-th of the sparse grid's; inputs are levels."""

    def __init__(self, window: int = 64, n_subsamples: int = 5, annualization: float = 252.0, update_every: int = 16):
        super().__init__(positive("window", window), update_every)
        self.k, self.year = min(positive("n_subsamples", n_subsamples), window), annualization

    def compute(self, own: Any, x: np.ndarray) -> list:
        moves = (x[:, self.k :] - x[:, : -self.k]) ** 2 if self.k < self.window else np.zeros((len(x), 0))
        sparse = moves[:, :: self.k]
        noise = sparse.mean(axis=1) * self.window if sparse.shape[1] else np.zeros(len(x))
        return (np.maximum(moves.sum(axis=1) / self.k - noise / self.k, 0.0) * self.year).tolist()


class MaxDiversification(Frame):
    """Weights along inverse covariance times deviations."""

    type = DOUBLES

    def __init__(self, n_assets: int = 3, period: int = 32, update_every: int = 8):
        super().__init__(positive("period", period), update_every)
        if not 1 <= n_assets <= 32:
            raise ValueError("n_assets must lie in 1..32")
        self.n = int(n_assets)

    def compute(self, own: Any, x: np.ndarray) -> list:
        d = x - x.mean(axis=1, keepdims=True)
        c = np.einsum("tki,tkj->tij", d, d) / max(1, self.window - 1)
        return [least_variance(m, np.maximum(np.sqrt(np.diag(m)), 1e-10)).tolist() for m in c]


ALL = {g.__name__: g for g in (EntropicVaR, EVTGpdTailRisk, JohnsonSUVaR, SpectralRiskMeasure, RealizedKernel, TwoScaleRealizedVariance, MaxDiversification)}
