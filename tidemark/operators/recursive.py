"""Operators that are recursions: kernels with a small state, one row at a time.

State vectors and matrices are NumPy arrays; where a model is linear and Gaussian one Kalman step serves them all.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pyarrow as pa

from ..functions.normal import probit
from ..plans.ordered import Kernel, Loop
from .rolling import between, positive

DOUBLES = pa.list_(pa.float64())
ESTIMATE = pa.struct([("value", pa.float64()), ("velocity", pa.float64()), ("covariance", DOUBLES)])
FACTORS = pa.struct([("alpha", pa.float64()), ("betas", DOUBLES), ("r2", pa.float64()), ("residual_variance", pa.float64())])


def estimate(value: float, velocity: float | None, covariance) -> dict:
    return {"value": float(value), "velocity": None if velocity is None else float(velocity), "covariance": [float(c) for c in covariance]}


# ---------------------------------------------------------------- linear recursions


class EwmaVariance(Loop):
    """v = (1 - alpha) v + alpha r^2, from r^2."""

    def __init__(self, alpha: float = 0.06):
        self.alpha = between("alpha", alpha, 0, 1)

    def start(self) -> list:
        return [None]

    def tick(self, state: list, r: float) -> float:
        state[0] = r * r if state[0] is None else state[0] + self.alpha * (r * r - state[0])
        return state[0]


class EwmaVolatility(EwmaVariance):
    def tick(self, state: list, r: float) -> float:
        return math.sqrt(super().tick(state, r))


class Garch(Loop):
    """Variance from the previous return and variance; parameters are given, never fitted."""

    def __init__(self, omega: float = 1e-6, alpha: float = 0.09, beta: float = 0.90):
        if omega < 0 or alpha < 0 or beta < 0:
            raise ValueError("omega, alpha and beta must not be negative")
        self.omega, self.alpha, self.beta = omega, alpha, beta

    def start(self) -> list:
        return [None, 0.0]

    def tick(self, state: list, r: float) -> float:
        v, before = state
        state[0] = self.omega + (self.alpha + self.beta) * r * r if v is None else self.omega + self.alpha * before * before + self.beta * v
        state[1] = r
        return math.sqrt(state[0])


class ConditionalDrawdownAtRisk(Loop):
    """Mean of the window's drawdowns at or above their quantile; drawdowns are against the all-time peak of wealth."""

    type = pa.struct([("cdar", pa.float64()), ("max_drawdown", pa.float64())])

    def __init__(self, window: int = 252, alpha: float = 0.95):
        self.window, self.alpha = positive("window", window), between("alpha", alpha, 0, 1)

    def start(self) -> dict:
        return {"wealth": 1.0, "peak": None, "most": 0.0, "last": []}

    def tick(self, state: dict, r: float) -> dict:
        state["wealth"] *= 1.0 + r
        state["peak"] = state["wealth"] if state["peak"] is None else max(state["peak"], state["wealth"])
        down = (state["peak"] - state["wealth"]) / state["peak"] if state["peak"] > 0 else 0.0
        state["most"] = max(state["most"], down)
        state["last"] = [*state["last"][1 - self.window :], down] if self.window > 1 else [down]
        recent = np.array(state["last"])
        bad = recent[recent >= np.quantile(recent, self.alpha)]
        return {"cdar": float(bad.mean()) if len(bad) else 0.0, "max_drawdown": state["most"]}


class AlphaBetaTracker(Loop):
    type = ESTIMATE

    def __init__(self, alpha: float = 0.5, beta: float = 0.1, dt: float = 1.0):
        if not (0 < alpha <= 1 and 0 <= beta <= 1 and dt > 0):
            raise ValueError("alpha must lie in (0, 1], beta in [0, 1], dt above 0")
        self.alpha, self.beta, self.dt = alpha, beta, dt

    def start(self) -> list:
        return [None, 0.0]

    def tick(self, state: list, z: float) -> dict:
        if state[0] is None:
            state[:] = z, 0.0
        else:
            guess = state[0] + state[1] * self.dt
            state[:] = guess + self.alpha * (z - guess), state[1] + self.beta / self.dt * (z - guess)
        return estimate(state[0], state[1], [])


class AdaptiveNotchFilter(Loop):
    """Second-order notch whose frequency follows the gradient of its output power."""

    type = pa.struct([("frequency", pa.float64()), ("filtered", pa.float64())])
    limits = (1e-4, math.pi - 1e-4)

    def __init__(self, rho: float = 0.95, mu: float = 1e-3, freq0: float = 0.05):
        self.rho = between("rho", rho, 0, 1)
        if mu <= 0:
            raise ValueError("mu must be positive")
        self.mu, self.freq0 = mu, freq0

    def start(self) -> dict:
        return {"omega": float(np.clip(2 * math.pi * self.freq0, *self.limits)), "x": (0.0, 0.0), "y": (0.0, 0.0), "d": (0.0, 0.0)}

    def tick(self, state: dict, x: float) -> dict:
        c, s, rho = math.cos(state["omega"]), math.sin(state["omega"]), self.rho
        (x1, x2), (y1, y2), (d1, d2) = state["x"], state["y"], state["d"]
        y = x - 2 * c * x1 + x2 + 2 * rho * c * y1 - rho * rho * y2
        slope = 2 * s * (x1 + rho * y1) + 2 * rho * c * d1 - rho * rho * d2
        omega = float(np.clip(state["omega"] - self.mu * y * slope, *self.limits))
        state.update(omega=omega, x=(x, x1), y=(y, y1), d=(slope, d1))
        return {"frequency": omega / (2 * math.pi), "filtered": y}


class PhaseLockedLoop(Loop):
    type = pa.struct([("frequency", pa.float64()), ("in_phase", pa.float64()), ("quadrature", pa.float64()), ("locked", pa.bool_())])

    def __init__(self, freq0: float = 0.1, kp: float = 0.2, ki: float = 0.01):
        self.freq0, self.kp, self.ki = freq0, kp, ki

    def start(self) -> dict:
        return {"phase": 0.0, "frequency": self.freq0, "sum": 0.0, "calm": 0}

    def tick(self, state: dict, x: float) -> dict:
        i, q = math.cos(state["phase"]), math.sin(state["phase"])
        error = -x * q
        state["sum"] += self.ki * error
        state["frequency"] = min(0.5, max(-0.5, state["frequency"] + self.kp * error + state["sum"]))
        turned = state["phase"] + 2 * math.pi * state["frequency"]
        if abs(turned) > math.pi:
            turned -= 2 * math.pi * math.copysign(1.0, turned)
        state["phase"] = turned
        state["calm"] = state["calm"] + 1 if abs(error) < 0.1 else 0
        return {"frequency": state["frequency"], "in_phase": i, "quadrature": q, "locked": state["calm"] > 50}


# ---------------------------------------------------------------- Kalman filters


class KalmanFilter(Loop):
    """Constant-velocity model observed in position."""

    type = ESTIMATE

    def __init__(self, dt: float = 1.0, q: float = 1e-3, r: float = 1.0, p0: float = 1.0):
        if dt <= 0 or r <= 0:
            raise ValueError("dt and r must be positive")
        self.f = np.array([[1.0, dt], [0.0, 1.0]])
        self.q = q * np.array([[dt**3 / 3, dt**2 / 2], [dt**2 / 2, dt]])
        self.r, self.p0 = r, p0

    def start(self) -> dict:
        return {"x": None, "p": self.p0 * np.eye(2)}

    def tick(self, state: dict, z: float) -> dict:
        if state["x"] is None:
            x, p = np.array([z, 0.0]), state["p"]
        else:
            x, p = self.f @ state["x"], self.f @ state["p"] @ self.f.T + self.q
        gain = p[:, 0] / (p[0, 0] + self.r)
        state["x"], state["p"] = x + gain * (z - x[0]), p - np.outer(gain, p[0])
        return estimate(*state["x"], state["p"].ravel())


class ExtendedKalman(Loop):
    """The same model from rest at zero, optionally observed as position + 0.1 velocity^2 (linearised)."""

    type = ESTIMATE

    def __init__(self, dt: float = 1.0, q: float = 1e-3, r: float = 1.0, p0: float = 1.0, nonlinear: bool = False):
        if dt <= 0 or r <= 0:
            raise ValueError("dt and r must be positive")
        self.model, self.nonlinear = KalmanFilter(dt, q, r, p0), nonlinear

    def start(self) -> dict:
        return {"x": np.zeros(2), "p": self.model.p0 * np.eye(2)}

    def observe(self, x: np.ndarray) -> np.ndarray:
        """Measurements of states in the last axis."""
        return x[..., 0] + (0.1 * x[..., 1] ** 2 if self.nonlinear else 0.0)

    def tick(self, state: dict, z: float) -> dict:
        m = self.model
        x, p = m.f @ state["x"], m.f @ state["p"] @ m.f.T + m.q
        h = np.array([1.0, 0.2 * x[1] if self.nonlinear else 0.0])
        gain = p @ h / (h @ p @ h + m.r)
        rest = np.eye(2) - np.outer(gain, h)
        state["x"], state["p"] = x + gain * (z - self.observe(x)), rest @ p @ rest.T + m.r * np.outer(gain, gain)
        return estimate(*state["x"], state["p"].ravel())


class UnscentedKalman(ExtendedKalman):
    """The same by five sigma points (kappa 1)."""

    spread = 3.0
    weights = np.array([1 / 3, 1 / 6, 1 / 6, 1 / 6, 1 / 6])

    def tick(self, state: dict, z: float) -> dict:
        m, x = self.model, state["x"]
        try:
            root = np.linalg.cholesky(state["p"])
        except np.linalg.LinAlgError:
            root = 1e-6 * np.eye(2)
        away = math.sqrt(self.spread) * root.T
        points = np.vstack([x, x + away, x - away]) @ m.f.T
        mean = self.weights @ points
        off = points - mean
        p = (self.weights[:, None] * off).T @ off + m.q
        seen = self.observe(points)
        expected = self.weights @ seen
        d = seen - expected
        across = self.weights * d @ off
        gain = across / (self.weights @ (d * d) + m.r)
        state["x"], state["p"] = mean + gain * (z - expected), p - np.outer(gain, across)
        return estimate(*state["x"], state["p"].ravel())


class SquareRootKalman(Loop):
    """Local level, the deviation kept instead of the variance."""

    type = ESTIMATE

    def __init__(self, q: float = 1e-3, r: float = 1e-2, s0: float = 1.0):
        if q < 0 or r <= 0 or s0 <= 0:
            raise ValueError("q must not be negative, r and s0 positive")
        self.q, self.r, self.s0 = q, r, s0

    def start(self) -> list:
        return [None, self.s0]

    def tick(self, state: list, z: float) -> dict:
        if state[0] is None:
            state[0] = z
        else:
            p = state[1] ** 2 + self.q
            gain = p / (p + self.r)
            state[:] = state[0] + gain * (z - state[0]), math.sqrt(max(0.0, (1 - gain) * p))
        return estimate(state[0], None, [state[1] ** 2])


class AdaptiveKalman(Loop):
    """Local level whose measurement noise follows the innovations' variance."""

    type = ESTIMATE

    def __init__(self, q: float = 1e-3, r: float = 1e-2, adapt: float = 0.05):
        self.q, self.r, self.adapt = q, r, between("adapt", adapt, 0, 1)

    def start(self) -> dict:
        return {"x": None, "p": max(self.r, 1e-6), "r": self.r, "m1": 0.0, "m2": 0.0}

    def tick(self, state: dict, z: float) -> dict:
        if state["x"] is None:
            state["x"] = z
        else:
            p, y, a = state["p"] + self.q, z - state["x"], self.adapt
            gain = p / (p + state["r"])
            m1, m2 = (1 - a) * state["m1"] + a * y, (1 - a) * state["m2"] + a * y * y
            noise = max(max(m2 - m1 * m1, 1e-12) - p, 1e-9)
            state.update(x=state["x"] + gain * y, p=(1 - gain) * p, r=(1 - a) * state["r"] + a * noise, m1=m1, m2=m2)
        return estimate(state["x"], None, [state["p"]])


class CubatureKalman(Loop):
    """Identity transition, first component observed; the 2n cubature points of an identity map only restate mean and covariance."""

    type = ESTIMATE

    def __init__(self, state_dim: int = 2, process_noise: float = 0.01, measurement_noise: float = 0.1):
        if not 1 <= state_dim <= 10:
            raise ValueError("state_dim must lie in 1..10")
        self.n, self.q, self.r = int(state_dim), process_noise, measurement_noise

    def start(self) -> dict:
        return {"x": None, "p": 0.1 * np.eye(self.n)}

    def tick(self, state: dict, z: float) -> dict:
        if state["x"] is None:
            state["x"] = np.r_[z, np.zeros(self.n - 1)]
        else:
            try:
                np.linalg.cholesky(state["p"])
            except np.linalg.LinAlgError:
                state["p"] = 0.1 * np.eye(self.n)
            p = state["p"] + self.q * np.eye(self.n)
            gain = p[:, 0] / (p[0, 0] + self.r)
            state["x"], state["p"] = state["x"] + gain * (z - state["x"][0]), p - np.outer(gain, p[0])
        return estimate(state["x"][0], state["x"][1] if self.n > 1 else None, np.diag(state["p"]))


class Random(Loop):
    """A recursion with random draws: seeded per series, so results do not depend on other series or on partitioning."""

    seed = 0x1DEA

    def rng(self) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64(self.seed))


class ParticleFilter(Random):
    """Bootstrap filter of a random walk; systematic resampling when half the particles are effectively lost."""

    type = ESTIMATE

    def __init__(self, n_particles: int = 200, process_noise: float = 0.01, measurement_noise: float = 0.1, state_min: float = -5.0, state_max: float = 5.0):
        positive("n_particles", n_particles)
        if process_noise <= 0 or measurement_noise <= 0:
            raise ValueError("noises must be positive")
        self.n, self.q, self.r, self.span = n_particles, process_noise, measurement_noise, (state_min, state_max)

    def start(self) -> dict:
        at = np.linspace(*self.span, self.n) if self.n > 1 else np.array([sum(self.span) / 2])
        return {"rng": self.rng(), "at": at, "w": np.full(self.n, 1 / self.n)}

    def tick(self, state: dict, z: float) -> dict:
        rng = state["rng"]
        at = state["at"] + self.q * rng.standard_normal(self.n)
        w = state["w"] * np.exp(-0.5 * ((z - at) / self.r) ** 2)
        total = w.sum()
        w = w / total if total > 1e-30 else np.full(self.n, 1 / self.n)
        if 1 / (w @ w) < self.n / 2:
            picks = np.searchsorted(np.cumsum(w), (rng.random() + np.arange(self.n)) / self.n)
            at, w = at[np.minimum(picks, self.n - 1)], np.full(self.n, 1 / self.n)
        state["at"], state["w"] = at, w
        mean = w @ at
        return estimate(mean, None, [w @ (at - mean) ** 2])


class EnsembleKalman(Random):
    """Ensemble moved by uniform noise in [0, 1) and updated by one gain; observations are not perturbed."""

    type = ESTIMATE

    def __init__(self, n_members: int = 50, state_dim: int = 2, process_noise: float = 0.01, measurement_noise: float = 0.1):
        positive("n_members", n_members, 2)
        self.n, self.d, self.q, self.r = n_members, positive("state_dim", state_dim), process_noise, measurement_noise

    def start(self) -> dict:
        return {"rng": self.rng(), "e": None}

    def tick(self, state: dict, z: float) -> dict:
        rng = state["rng"]
        if state["e"] is None:
            e = z + (rng.random((self.n, self.d)) - 0.5) * self.r
            e[:, 1:] += (rng.random((self.n, self.d - 1)) - 0.5) * 0.1
        else:
            e = state["e"]
        e = e + self.q * rng.random((self.n, self.d))
        spread = e[:, 0].var(ddof=1)
        e[:, 0] += spread / (spread + self.r**2) * (z - e[:, 0])
        state["e"] = e
        return estimate(e[:, 0].mean(), e[:, 1].mean() if self.d > 1 else None, [e[:, 0].var(ddof=1)])


# ---------------------------------------------------------------- adaptive prediction and factor models


class LmsFilter(Loop):
    """One-step predictor by least mean squares; weight 0 belongs to the oldest sample."""

    def __init__(self, order: int = 4, mu: float = 0.01):
        self.order = positive("order", order)
        if mu <= 0:
            raise ValueError("mu must be positive")
        self.mu = mu

    def start(self) -> dict:
        return {"w": np.zeros(self.order), "last": np.empty(0)}

    def tick(self, state: dict, x: float) -> float | None:
        last, guess = state["last"], None
        if len(last) == self.order:
            guess = float(state["w"] @ last)
            state["w"] = state["w"] + self.mu * (x - guess) * last
        state["last"] = np.append(last, x)[-self.order :]
        return guess


class Recursive:
    """Recursive least squares with intercept and forgetting."""

    def __init__(self, features: int, forget: float, p0: float):
        self.forget, self.theta, self.p = forget, np.zeros(features + 1), p0 * np.eye(features + 1)
        self.n, self.sum_y, self.sum_y2, self.rss = 0, 0.0, 0.0, 0.0

    def learn(self, x: np.ndarray, y: float) -> None:
        u = np.r_[1.0, x]
        pu = self.p @ u
        bottom = self.forget + u @ pu
        if abs(bottom) < 1e-18:
            return
        self.theta = self.theta + pu / bottom * (y - u @ self.theta)
        self.p = (self.p - np.outer(pu, pu) / bottom) / self.forget
        left = y - u @ self.theta
        self.n, self.sum_y, self.sum_y2, self.rss = self.n + 1, self.sum_y + y, self.sum_y2 + y * y, self.rss + left * left

    def guess(self, x: np.ndarray) -> float:
        return float(self.theta[0] + self.theta[1:] @ x)

    def result(self) -> dict:
        spread = self.sum_y2 - self.sum_y**2 / self.n if self.n else 0.0
        r2 = float(np.clip(1 - self.rss / spread, -1, 1)) if self.n >= 2 and spread > 1e-18 else 0.0
        return {"alpha": float(self.theta[0]), "betas": self.theta[1:].tolist(), "r2": r2, "residual_variance": self.rss / self.n if self.n else 0.0}


class RlsFilter(Loop):
    def __init__(self, order: int = 4, lam: float = 1.0):
        self.order = positive("order", order)
        if not 0 < lam <= 1:
            raise ValueError("lam must lie in (0, 1]")
        self.lam = lam

    def start(self) -> dict:
        return {"fit": Recursive(self.order, self.lam, 100.0), "last": np.empty(0)}

    def tick(self, state: dict, x: float) -> float | None:
        last, guess = state["last"], None
        if len(last) == self.order:
            guess = state["fit"].guess(last)
            state["fit"].learn(last, x)
        state["last"] = np.append(last, x)[-self.order :]
        return guess


class MultiFactorModel(Loop):
    """Excess return on factors; ``period`` sets the forgetting 1 - 1 / period. Inputs: asset, factors (an array), risk_free."""

    type = FACTORS

    def __init__(self, n_factors: int, period: int = 252):
        self.n, self.forget = positive("n_factors", n_factors), 1.0 - 1.0 / positive("period", period, 2)

    def start(self) -> Recursive:
        return Recursive(self.n, self.forget, 1e6)

    def tick(self, state: Recursive, asset: float, factors: Any, risk_free: float = 0.0) -> dict:
        state.learn(np.asarray(factors, float), asset - risk_free)
        return state.result()


class _Named(MultiFactorModel):
    """Factors as columns of their own: asset, the factors, then risk_free."""

    factors = 0

    def __init__(self, period: int = 252):
        super().__init__(self.factors, period)

    def tick(self, state: Recursive, asset: float, *rest: float) -> dict:
        return super().tick(state, asset, rest[: self.factors], rest[self.factors] if len(rest) > self.factors else 0.0)


class FamaFrench3(_Named):
    factors = 3


class Carhart4(_Named):
    factors = 4


class FamaFrench5(_Named):
    factors = 5


class TreynorMazuy(MultiFactorModel):
    """Market timing: excess return on the market's excess and its square; inputs asset, market, risk_free."""

    def __init__(self, period: int = 252):
        super().__init__(2, period)

    def tick(self, state: Recursive, asset: float, market: float, risk_free: float = 0.0) -> dict:
        m = market - risk_free
        return super().tick(state, asset, (m, m * m), risk_free)


# ---------------------------------------------------------------- covariance and portfolios


class EwmaCovarianceMatrix(Kernel):
    """Covariance (row-major) in which ``lam`` weighs the newest outer product."""

    type = DOUBLES

    def __init__(self, n_assets: int, lam: float = 0.94):
        self.n, self.lam = positive("n_assets", n_assets), between("lam", lam, 0, 1)

    def start(self) -> dict:
        return {"c": None}

    def advance(self, state: dict, x: np.ndarray) -> np.ndarray:
        outer = np.outer(x, x)
        state["c"] = outer if state["c"] is None else (1 - self.lam) * state["c"] + self.lam * outer
        return state["c"]

    def step(self, state: dict, returns: np.ndarray) -> tuple[dict, list]:
        if returns.shape[1] != self.n:
            raise ValueError(f"{self.n} returns are expected in each row")
        return state, [self.advance(state, x).ravel().tolist() for x in returns]


class ComponentMarginalVaR(EwmaCovarianceMatrix):
    """Total, marginal and component value at risk of the weights in each row."""

    type = pa.struct([("total_var", pa.float64()), ("marginal", DOUBLES), ("component", DOUBLES)])

    def __init__(self, n_assets: int, lam: float = 0.94, confidence: float = 0.95):
        super().__init__(n_assets, lam)
        self.z = probit(between("confidence", confidence, 0, 1))

    def step(self, state: dict, returns: np.ndarray, weights: np.ndarray) -> tuple[dict, list]:
        out = []
        for x, w in zip(returns, weights, strict=True):
            c = self.advance(state, x)
            vol = math.sqrt(max(0.0, w @ c @ w))
            marginal = self.z * (c @ w) / vol if vol > 1e-18 else np.zeros(self.n)
            out.append({"total_var": self.z * vol if vol > 1e-18 else 0.0, "marginal": marginal.tolist(), "component": (w * marginal).tolist()})
        return state, out


def least_variance(c: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights along inverse(c) target, summing to one; equal ones where c is not positive definite."""
    n = len(c)
    try:
        np.linalg.cholesky(c)
        w = np.linalg.solve(c, target)
        return w / w.sum() if abs(w.sum()) >= 1e-30 else np.full(n, 1 / n)
    except np.linalg.LinAlgError:
        return np.full(n, 1 / n)


class ExponentiallyWeightedPortfolio(Kernel):
    """Minimum-variance weights of exponentially decaying mean and covariance (here ``lam`` is the decay)."""

    type = DOUBLES

    def __init__(self, n_assets: int = 3, lam: float = 0.94):
        if not 1 <= n_assets <= 32:
            raise ValueError("n_assets must lie in 1..32")
        self.n, self.lam = int(n_assets), between("lam", lam, 0, 1)

    def start(self) -> dict:
        return {"m": None, "c": np.zeros((self.n, self.n))}

    def step(self, state: dict, returns: np.ndarray) -> tuple[dict, list]:
        out = []
        for x in returns:
            if state["m"] is None:
                state["m"] = x.copy()
                out.append([1 / self.n] * self.n)
                continue
            state["m"] = self.lam * state["m"] + (1 - self.lam) * x
            d = x - state["m"]
            state["c"] = self.lam * state["c"] + (1 - self.lam) * np.outer(d, d)
            out.append(least_variance(state["c"], np.ones(self.n)).tolist())
        return state, out


ALL = {
    g.__name__: g
    for g in (
        EwmaVariance, EwmaVolatility, Garch, ConditionalDrawdownAtRisk, AlphaBetaTracker, AdaptiveNotchFilter, PhaseLockedLoop, KalmanFilter, ExtendedKalman,
        UnscentedKalman, SquareRootKalman, AdaptiveKalman, CubatureKalman, ParticleFilter, EnsembleKalman, LmsFilter, RlsFilter, MultiFactorModel,
        FamaFrench3, Carhart4, FamaFrench5, TreynorMazuy, EwmaCovarianceMatrix, ComponentMarginalVaR, ExponentiallyWeightedPortfolio,
    )
}
