"""Predictors whose coefficients are fitted on a cadence and used at every row in between."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..plans.ordered import Kernel
from . import numerics as nx
from .rolling import positive
from .spectral import DOUBLES


class Fitted(Kernel):
    """Emits from row ``window`` on. Coefficients are fitted at window + every - 1 + j * every, all of a batch together, and hold until the next."""

    def __init__(self, window: int, order: int, every: int):
        self.window, self.order, self.every = positive("window", window), positive("order", order), positive("update_every", every)
        if window <= order + 1:
            raise ValueError("window must exceed order + 1")

    def start(self) -> dict:
        return {"seen": 0, "tail": np.empty(0), "fit": np.zeros(self.order)}

    def fits(self, windows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def emit(self, state: dict, data: np.ndarray, lead: int, fits: np.ndarray, ready: np.ndarray) -> list:
        """Outputs for every new row (data from ``lead`` on), with its coefficients; null where not ready."""
        raise NotImplementedError

    def step(self, state: dict, x: np.ndarray) -> tuple[dict, list]:
        w, n = self.window, len(x)
        data, lead = np.concatenate([state["tail"], x]), len(state["tail"])
        seq = np.arange(state["seen"] + 1, state["seen"] + n + 1)
        first = w + self.every - 1
        ticks = np.flatnonzero((seq >= first) & ((seq - first) % self.every == 0))
        held = np.vstack([state["fit"][None, :], self.fits(data[(lead + ticks)[:, None] + np.arange(1 - w, 1)]) if len(ticks) else np.empty((0, self.order))])
        use = np.zeros(n, int)
        use[ticks] = 1
        out = self.emit(state, data, lead, held[np.cumsum(use)], seq >= w)
        state.update(seen=int(seq[-1]), tail=data[max(0, len(data) - w) :].copy(), fit=held[-1])
        return state, out

    def lags(self, data: np.ndarray, lead: int, first: int) -> np.ndarray:
        """For each new row the values ``first``, first + 1, ... rows back; 0 before the series."""
        padded = np.concatenate([np.zeros(self.order + first), data])
        at = np.arange(lead, len(data))[:, None] + self.order + first
        return padded[at - first - np.arange(self.order)]


class LpcPredictor(Fitted):
    """Linear prediction of each row from those before it; zeros until the first fit."""

    type = pa.struct([("prediction", pa.float64()), ("coefficients", DOUBLES)])

    def __init__(self, window: int = 64, order: int = 8, update_every: int = 8):
        super().__init__(window, order, update_every)

    def fits(self, windows: np.ndarray) -> np.ndarray:
        return nx.levinson(nx.autocorrelation(windows, self.order), self.order)[0]

    def emit(self, state: dict, data: np.ndarray, lead: int, fits: np.ndarray, ready: np.ndarray) -> list:
        guess = (fits * self.lags(data, lead, 1)).sum(axis=1)
        return [{"prediction": float(g), "coefficients": f.tolist()} if r else None for g, f, r in zip(guess, fits, ready, strict=True)]


class WienerHopfFilter(Fitted):
    """Filter towards a three-point mean, designed from the window's correlations; 0 until the first design."""

    def __init__(self, window: int = 64, order: int = 4, update_every: int = 8):
        super().__init__(window, order, update_every)

    def fits(self, windows: np.ndarray) -> np.ndarray:
        p, n, out = self.order, self.window, []
        for x in windows:
            wide = np.concatenate([[0.0], x, [0.0]])
            counts = np.full(n, 3.0)
            counts[[0, -1]] = 2.0
            goal = (wide[:-2] + wide[1:-1] + wide[2:]) / counts
            d, g = x - x.mean(), goal - goal.mean()
            cross = np.array([(d[: n - i] * g[i:]).sum() / n for i in range(p)])
            h = nx.solve(nx.toeplitz(nx.autocorrelation(x, p - 1), p), cross)
            out.append(np.r_[1.0 / p, np.zeros(p - 1)] if h is None else h)
        return np.array(out)

    def emit(self, state: dict, data: np.ndarray, lead: int, fits: np.ndarray, ready: np.ndarray) -> tuple:
        return (fits * self.lags(data, lead, 0)).sum(axis=1), ready


class LatticePredictionErrorFilter(Fitted):
    """Prediction error of a lattice with Burg reflections; the backward errors pass from row to row, the row itself until the first fit."""

    def __init__(self, window: int = 64, order: int = 8, update_every: int = 8):
        super().__init__(window, order, update_every)

    def start(self) -> dict:
        return super().start() | {"back": np.zeros(self.order)}

    def fits(self, windows: np.ndarray) -> np.ndarray:
        return nx.burg(windows, self.order)[1]

    def emit(self, state: dict, data: np.ndarray, lead: int, fits: np.ndarray, ready: np.ndarray) -> tuple:
        out = np.zeros(len(ready))
        for t in np.flatnonzero(ready):
            ahead, back = data[lead + t], state["back"]
            new = np.empty(self.order)
            new[0] = ahead
            for m, k in enumerate(fits[t]):
                if m + 1 < self.order:
                    new[m + 1] = back[m] - k * ahead
                ahead = ahead - k * back[m]
            state["back"], out[t] = new, ahead
        return out, ready


ALL = {g.__name__: g for g in (LpcPredictor, WienerHopfFilter, LatticePredictionErrorFilter)}
