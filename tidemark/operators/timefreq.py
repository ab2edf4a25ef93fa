"""Time-frequency and higher-order operators on a cadence."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa


from . import numerics as nx
from .numerics import TAU
from .rolling import positive
from .spectral import DOUBLES, Periodogram, Spectrum, records

ANALYTIC = pa.struct([("amplitude", pa.float64()), ("phase", pa.float64()), ("frequency", pa.float64())])
BISPECTRUM = pa.struct([("values", DOUBLES), ("frequencies", DOUBLES), ("entropy", pa.float64()), ("total_coupling", pa.float64())])
BICOHERENCE = pa.struct([("values", DOUBLES), ("frequencies", DOUBLES), ("peak", pa.float64())])


class ShortTimeFourierTransform(Periodogram):
    """Magnitudes of one tapered window in every ``hop`` rows."""

    def __init__(self, window: int = 256, hop: int = 128, fs: float = 1.0, window_type: str = "hann"):
        super().__init__(window, hop, fs, window_type)

    def density(self, x: np.ndarray) -> np.ndarray:
        return np.abs(np.fft.rfft(x * self.taper, axis=1))


class HilbertTransform(Spectrum):
    """Analytic signal at the centre of the window."""

    type = ANALYTIC

    def __init__(self, window: int = 128, update_every: int = 64, fs: float = 1.0):
        super().__init__(max(2, window), update_every)
        self.fs = fs

    def centre(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.window
        half = np.fft.fft(x, axis=1)
        half[:, 1 : n // 2] *= 2
        half[:, n // 2 + 1 :] = 0
        z = np.fft.ifft(half, axis=1)[:, n // 2 - 1 : n // 2 + 1]
        phase = np.angle(z)
        return np.abs(z[:, 1]), phase[:, 1], nx.wrapped(phase[:, 1] - phase[:, 0]) / TAU * self.fs

    def compute(self, own: Any, x: np.ndarray) -> list:
        return [dict(zip(("amplitude", "phase", "frequency"), map(float, v), strict=True)) for v in zip(*self.centre(x), strict=True)]


class InstantaneousFrequency(HilbertTransform):
    type = pa.float64()

    def compute(self, own: Any, x: np.ndarray) -> list:
        return self.centre(x)[2].tolist()


class Padded(Spectrum):
    """Spectra of a window padded to ``nfft`` values."""

    rounded = False

    def __init__(self, window: int = 64, nfft: int = 64, update_every: int = 16):
        super().__init__(window, update_every)
        self.nfft = nx.power_of_two(nfft)
        if self.nfft < window:
            raise ValueError("nfft must not be below window")


class StockwellTransform(Padded):
    """Power at the window's middle, each bin under a Gaussian as wide as its index."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, m = self.nfft, self.window // 2
        spectrum = np.fft.fft(x, n, axis=1)
        at, power = np.arange(n), np.empty((len(x), n // 2 + 1))
        power[:, 0] = np.abs(spectrum[:, 0]) ** 2
        turn = np.exp(1j * TAU * at * m / n) / n
        for k in range(1, n // 2 + 1):
            power[:, k] = np.abs((np.roll(spectrum, -k, axis=1) * np.exp(-0.5 * (at / k) ** 2)) @ turn) ** 2 / n
        return records(self.grid(n), power)


def moved(power: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Power gathered at target bins; what would leave the spectrum stays."""
    rows, bins = power.shape
    inside = (target >= 0) & (target < bins)
    to = np.where(inside, target, np.arange(bins)).astype(int) + np.arange(rows)[:, None] * bins
    return np.bincount(to.ravel(), power.ravel(), rows * bins).reshape(rows, bins)


def rounded(x: np.ndarray) -> np.ndarray:
    """To the nearest whole number, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


class ReassignedSpectrogram(Padded):
    """Each bin's power at the frequency that a window moved by one row suggests."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, w = self.nfft, nx.taper("hann", self.window)
        a = np.fft.rfft(x * w, n, axis=1)
        b = np.fft.rfft(x * np.r_[w[1:], 0.0], n, axis=1)
        turn = nx.wrapped(np.angle(b) - np.angle(a))
        target = rounded(np.arange(n // 2 + 1) + turn * n / (TAU * self.window))
        return records(self.grid(n), moved(np.abs(a) ** 2, target))


class SynchrosqueezingTransform(Padded):
    """The first half window's power where the phase advance to the second half puts it."""

    def __init__(self, window: int = 64, nfft: int = 128, update_every: int = 16):
        super().__init__(window, nfft, update_every)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, half = self.nfft, self.window // 2
        w = nx.taper("hann", self.window)[:half]
        a, b = (np.fft.rfft(v * w, n, axis=1) for v in (x[:, :half], x[:, half : 2 * half]))
        turn = nx.wrapped(np.angle(b) - np.angle(a))
        target = rounded(np.arange(n // 2 + 1) + turn * n / (TAU * max(1, half)))
        return records(self.grid(n), moved(np.abs(a) ** 2, target))


class ConstantQTransform(Spectrum):
    """One octave from f_min in n_bins bins, each against a kernel over the window's oldest rows; f_max is not used."""

    rounded = False

    def __init__(self, window: int = 64, n_bins: int = 24, f_min: float = 0.01, f_max: float = 0.4, update_every: int = 16):
        super().__init__(window, update_every)
        q = 1.0 / (2.0 ** (1.0 / positive("n_bins", n_bins)) - 1.0)
        self.freqs = f_min * 2.0 ** (np.arange(n_bins) / n_bins)
        self.kernels = np.zeros((window, n_bins), complex)
        for b, f in enumerate(self.freqs):
            n = min(max(int(rounded(q / f)), 2), window)
            i = np.arange(n)
            self.kernels[:n, b] = np.exp(-0.5 * ((i - n / 2) / n * q) ** 2 + 1j * TAU * f * i) / n

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        return records(self.freqs, np.abs(x @ self.kernels) ** 2)


class FractionalFourierTransform(Spectrum):
    """Chirp, transform, chirp, back, chirp; ``angle`` counts right angles."""

    rounded = False

    def __init__(self, window: int = 64, angle: float = np.pi / 2, update_every: int = 16):
        super().__init__(window, update_every)
        self.alpha = angle * np.pi / 2

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, m = self.window, nx.power_of_two(self.window)
        still = abs(self.alpha) < 1e-10
        cot, csc = (1e10, 1.0) if still else (1 / np.tan(self.alpha), 1 / np.sin(self.alpha))
        chirp = lambda at: np.exp(1j * np.pi * at * at * cot / n)
        z = np.fft.fft(x * chirp(np.arange(n) - n / 2), m, axis=1) * chirp(np.arange(m) - m / 2)
        z = np.fft.ifft(z, axis=1)
        z[:, :n] *= chirp(np.arange(n) - n / 2) * (np.exp(-self.alpha) * np.sqrt(csc) / m)
        return records(self.grid(m), np.abs(z[:, : m // 2 + 1]) ** 2)


class WignerVilleDistribution(Spectrum):
    """Transform of the products of rows equally far from the window's middle."""

    rounded = False

    def __init__(self, window: int = 64, nfft: int = 64, update_every: int = 16):
        super().__init__(window, update_every)
        self.nfft = nx.power_of_two(nfft)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, freqs = self.window, self.grid(self.nfft)
        lag = np.arange(n)
        up, down = n // 2 + lag // 2, n // 2 - lag // 2
        lag, up, down = (v[(up < n) & (down >= 0)] for v in (lag, up, down))
        turn = np.exp(-1j * np.pi * np.outer(lag, freqs))
        return records(freqs, np.abs((x[:, up] * x[:, down]) @ turn) / n)


class ChirpZTransform(Spectrum):
    """Power at n_points frequencies of a band."""

    rounded = False

    def __init__(self, window: int = 64, f_start: float = 0.1, f_end: float = 0.3, n_points: int = 64, update_every: int = 16):
        super().__init__(window, update_every)
        self.freqs = f_start + np.arange(positive("n_points", n_points)) * (f_end - f_start) / max(1, n_points - 1)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        return records(self.freqs, np.abs(x @ np.exp(-1j * TAU * np.outer(np.arange(self.window), self.freqs))) ** 2)


class KurtogramAnalysis(Padded):
    """Kurtosis, less 3, of each bin's magnitude over the window's suffixes from four starts."""

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, size = self.window, []
        for start in range(0, 4 * (n // 4), max(1, n // 4)) if n >= 4 else [0] * 4:
            part = x[:, start:]
            size.append(np.abs(np.fft.rfft(part * nx.taper("hann", part.shape[1]) if part.shape[1] > 1 else part, self.nfft, axis=1)))
        m2, m4 = (np.mean([s**p for s in size], axis=0) for p in (2, 4))
        return records(self.grid(self.nfft), np.where(m2 > 1e-30, m4 / np.where(m2 > 1e-30, m2, 1.0) ** 2 - 3, 0.0))


class BispectrumAnalysis(Padded):
    """|X(f1) X(f2) X*(f1 + f2)| of one segment, row-major; its entropy and the sum of its squares."""

    type = BISPECTRUM
    together = 32

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: magnitudes of X, and of the triple product where the sum is a bin; and where it is."""
        z = np.abs(np.fft.rfft(x, self.nfft, axis=1))
        bins = z.shape[1]
        third = np.arange(bins)[:, None] + np.arange(bins)[None, :]
        inside = third < bins
        return z, z[:, :, None] * z[:, None, :] * z[:, np.where(inside, third, 0)] * inside, inside

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        _, b, _ = self.products(x)
        b = b.reshape(len(x), -1) / self.nfft**2
        total = b.sum(axis=1, keepdims=True)
        share = b / np.where(total > 0, total, 1.0)
        entropy = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=1) / np.log(b.shape[1])
        f = self.grid(self.nfft).tolist()
        return [{"values": v.tolist(), "frequencies": f, "entropy": float(e), "total_coupling": float((v * v).sum())} for v, e in zip(b, entropy, strict=True)]


class BicoherenceAnalysis(BispectrumAnalysis):
    """The same against the product of powers: one wherever that is above 1e-30, for there is a single segment."""

    type = BICOHERENCE

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        z, b, inside = self.products(x)
        p = z * z
        third = np.where(inside, np.arange(z.shape[1])[:, None] + np.arange(z.shape[1])[None, :], 0)
        below = np.maximum(p[:, :, None] * p[:, None, :], 1e-30) * np.maximum(p[:, third], 1e-30)
        c = (np.where(below > 1e-30, np.minimum(b * b / np.maximum(below, 1e-300), 1.0), 0.0) * inside).reshape(len(x), -1)
        f = self.grid(self.nfft).tolist()
        return [{"values": v.tolist(), "frequencies": f, "peak": float(v.max())} for v in c]


ALL = {
    g.__name__: g
    for g in (
        ShortTimeFourierTransform, HilbertTransform, InstantaneousFrequency, StockwellTransform, ReassignedSpectrogram, SynchrosqueezingTransform, ConstantQTransform,
        FractionalFourierTransform, WignerVilleDistribution, ChirpZTransform, KurtogramAnalysis, BispectrumAnalysis, BicoherenceAnalysis,
    )
}
