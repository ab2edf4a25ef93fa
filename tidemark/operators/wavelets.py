"""Wavelet operators on a cadence: Haar throughout, as records of coefficients and scales."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa

from ..plans.ordered import Frame
from . import numerics as nx
from .numerics import TAU
from .rolling import positive
from .spectral import DOUBLES, SPECTRUM

WAVELET = pa.struct([("coefficients", DOUBLES), ("scales", DOUBLES)])


def waves(coefficients: np.ndarray, scales: Sequence[float] | None = None) -> list[dict]:
    s = None if scales is None else [float(v) for v in scales]
    return [{"coefficients": c.tolist(), "scales": s} for c in coefficients]


def dyadic(levels: int) -> list[float]:
    return [float(1 << (j + 1)) for j in range(levels)]


class Wavelet(Frame):
    type = WAVELET
    rounded = True
    most_levels: int | None = None

    def __init__(self, window: int = 64, levels: int = 3, update_every: int = 16):
        positive("window", window)
        super().__init__(nx.power_of_two(window) if self.rounded else window, update_every)
        self.levels = positive("levels", levels)
        if self.most_levels and levels > self.most_levels:
            raise ValueError(f"levels must not exceed {self.most_levels}")


class DiscreteWaveletTransform(Wavelet):
    """All levels: the last sum, then differences from coarse to fine."""

    def __init__(self, window: int = 64, update_every: int = 16):
        super().__init__(window, 1, update_every)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        low, details = nx.haar_levels(x, self.window.bit_length())
        return waves(np.concatenate([low, *details[::-1]], axis=1))


class Modwt(Wavelet):
    """The newest undecimated difference of each level."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        _, details = nx.circular_details(x, self.levels)
        return waves(np.stack([d[:, -1] for d in details], axis=1), dyadic(self.levels))


class MultiresolutionAnalysis(Modwt):
    pass


class WaveletVariance(Wavelet):
    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        _, details = nx.circular_details(x, self.levels)
        return waves(np.stack([d.var(axis=1) for d in details], axis=1), dyadic(self.levels))


class WaveletPacket(Wavelet):
    """The full tree in natural order; a node of one value stands for both of its children."""

    def __init__(self, window: int = 64, levels: int = 2, update_every: int = 16):
        super().__init__(window, levels, update_every)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        nodes = [x]
        for _ in range(self.levels):
            nodes = [half for node in nodes for half in (nx.haar(node) if node.shape[1] > 1 else (node, node))]
        return waves(np.concatenate(nodes, axis=1))


class CwtMorlet(Frame):
    """Magnitude of a Morlet wavelet (frequency 6) centred at the newest row, at each scale."""

    type = WAVELET

    def __init__(self, window: int = 64, scales: Sequence[float] = (2.0, 4.0, 8.0, 16.0), update_every: int = 16):
        super().__init__(nx.power_of_two(positive("window", window)), update_every)
        if not len(scales) or min(scales) <= 0:
            raise ValueError("scales must be positive")
        self.scales = np.array(scales, float)
        tau = (np.arange(self.window) - (self.window - 1))[:, None] / self.scales
        self.kernel = np.exp(-0.5 * tau**2 - 6j * tau) * np.pi**-0.25 / np.sqrt(self.scales)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        return waves(np.abs(x @ self.kernel), self.scales)


class WaveletCorrelation(Wavelet):
    """Correlation of two channels' undecimated differences at each scale; 0 where one of them is constant."""

    type = SPECTRUM
    power = 1

    def compute(self, own: Any, x: np.ndarray, y: np.ndarray) -> list[dict]:
        each = []
        for a, b in zip(nx.circular_details(x, self.levels)[1], nx.circular_details(y, self.levels)[1], strict=True):
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
            below = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            each.append(np.where(below > 1e-18, (a * b).sum(axis=1) / np.where(below > 1e-18, below, 1.0), 0.0) ** self.power)
        scales = dyadic(self.levels)
        return [{"frequencies": scales, "power": p.tolist(), "dominant_frequency": None, "peak_power": None} for p in np.stack(each, axis=1)]


class WaveletCoherence(WaveletCorrelation):
    power = 2


class Plain(Wavelet):
    """Haar levels of the window as it is; an odd value at the end of a level is left out."""

    rounded = False
    most_levels = 8


class DualTreeCwt(Plain):
    """A Haar tree and one moved by a row, interleaved as real and imaginary parts."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        a, b, real, imag = x, x, [], []
        while len(real) < self.levels and a.shape[1] > 1:
            at = np.minimum(np.arange(1, 2 * (b.shape[1] // 2) + 1), b.shape[1] - 1)
            a, d = nx.haar(a)
            b, e = nx.haar(b[:, at])
            real.append(d)
            imag.append(e)
        both = np.stack([np.concatenate([*real, a], axis=1), np.concatenate([*imag, b], axis=1)], axis=2)
        return waves(both.reshape(len(x), -1), dyadic(len(real)))


class EmpiricalWaveletTransform(Frame):
    """Modes between the deepest minima of the magnitude spectrum, rebuilt from magnitudes at zero phase."""

    type = WAVELET
    edge = 0.1

    def __init__(self, window: int = 64, n_modes: int = 3, update_every: int = 16):
        super().__init__(window, update_every)
        if not 1 <= n_modes <= 16:
            raise ValueError("n_modes must lie in 1..16")
        self.modes = int(n_modes)

    def pass_band(self, away: np.ndarray, width: float) -> np.ndarray:
        flat, slope = width / 2 - self.edge * width, 2 * self.edge * width
        rise = np.sqrt(np.maximum(0.0, 0.5 + 0.5 * np.cos(np.pi * (flat + slope - away) / slope)))
        return np.where(away <= flat, 1.0, np.where(away <= flat + slope, rise, 0.0))

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, m = self.window, nx.power_of_two(self.window)
        out = []
        for s in np.abs(np.fft.rfft(x, m, axis=1)):
            inner = np.arange(1, len(s) - 1)
            low = inner[(s[inner] <= s[inner - 1]) & (s[inner] <= s[inner + 1])]
            cuts = [0, *sorted(low[np.argsort(s[low], kind="stable")][: self.modes - 1].tolist()), len(s)]
            parts, widths = [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                k = np.arange(a, b)
                width = max(1, b - a)
                weight = s[a:b] * self.pass_band(np.abs(k - (a + b) // 2).astype(float), float(width))
                parts.append(np.cos(TAU / m * np.outer(np.arange(n), k)) @ weight / m)
                widths.append(float(width))
            out.append({"coefficients": np.concatenate(parts).tolist(), "scales": widths})
        return out


class TunableQWavelet(Frame):
    """Levels of resampled rows with gains from the quality factor."""

    type = WAVELET

    def __init__(self, window: int = 64, levels: int = 4, q_factor: float = 2.0, update_every: int = 16):
        super().__init__(window, update_every)
        if not 1 <= levels <= 12 or q_factor < 1:
            raise ValueError("levels must lie in 1..12 and q_factor be at least 1")
        self.levels, self.q = int(levels), float(q_factor)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        keep, gain = 1 - (self.q - 1) / (self.q + 1), 2 / (self.q + 1)
        away = lambda v: np.floor(v + 0.5)
        parts, level = [], 0
        while level < self.levels and x.shape[1] > 1:
            n = x.shape[1]
            half = min(max(int(away(n * keep)), 1), n - 1)
            low = np.minimum(away(np.arange(half) / keep), n - 1).astype(int)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.nan_to_num(np.arange(n - half) / (1 - keep), nan=-float(half), posinf=float(n))
            high = np.minimum(away(half + step), n - 1).astype(int)
            parts.append(x[:, high] * (1 - gain))
            x, level = x[:, low] * gain, level + 1
        return waves(np.concatenate([*parts, x], axis=1), dyadic(level))


class SureShrinkDenoise(Plain):
    """Haar differences shrunk by one universal threshold from the finest level."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        low, details = nx.haar_levels(x, self.levels)
        if details:
            by = nx.deviation(details[0]) * np.sqrt(np.log(2.0 * self.window))
            details = [nx.shrunk(d, by) for d in details]
        return waves(nx.unhaar(low, details))


class StationaryWaveletDenoise(Plain):
    """Undecimated differences shrunk likewise, then everything summed."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        low, details = nx.circular_details(x, self.levels, ahead=True)
        by = nx.deviation(details[0]) * np.sqrt(np.log(2.0 * self.window))
        return waves(low + sum(nx.shrunk(d, by) for d in details))


class WaveletRegression(Plain):
    """Haar differences shrunk by a threshold of their own level."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        low, details = nx.haar_levels(x, self.levels)
        by = [nx.deviation(d) * np.sqrt(2 * np.log(d.shape[1])) / np.sqrt(1.0 + j) for j, d in enumerate(details)]
        return waves(nx.unhaar(low, [nx.shrunk(d, b) for d, b in zip(details, by, strict=True)]))


class CrossWaveletTransform(Plain):
    """Root of the summed squares of two channels' differences, level by level."""

    def compute(self, own: Any, x: np.ndarray, y: np.ndarray) -> list[dict]:
        both = [np.hypot(a, b) for a, b in zip(nx.haar_levels(x, self.levels)[1], nx.haar_levels(y, self.levels)[1], strict=True)]
        return waves(np.concatenate(both, axis=1) if both else np.empty((len(x), 0)), dyadic(len(both)))


class WaveletPhaseSynchrony(Plain):
    """Size of the mean of 2xy / (x^2 + y^2) over each level's differences, counting 1 where both vanish."""

    def compute(self, own: Any, x: np.ndarray, y: np.ndarray) -> list[dict]:
        each = []
        for a, b in zip(nx.haar_levels(x, self.levels)[1], nx.haar_levels(y, self.levels)[1], strict=True):
            each.append(np.abs(np.cos(np.arctan2(a, b) - np.arctan2(b, a)).mean(axis=1)))
        return waves(np.stack(each, axis=1) if each else np.empty((len(x), 0)), dyadic(len(each)))


ALL = {
    g.__name__: g
    for g in (
        DiscreteWaveletTransform, Modwt, MultiresolutionAnalysis, WaveletVariance, WaveletPacket, CwtMorlet, WaveletCorrelation, WaveletCoherence, DualTreeCwt,
        EmpiricalWaveletTransform, TunableQWavelet, SureShrinkDenoise, StationaryWaveletDenoise, WaveletRegression, CrossWaveletTransform, WaveletPhaseSynchrony,
    )
}
