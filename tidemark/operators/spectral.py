"""Spectra of the last rows of a series, recomputed on a cadence; many windows are transformed together."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ordered import Frame, Kernel
from . import numerics as nx
from .numerics import TAU
from .rolling import positive

DOUBLES = pa.list_(pa.float64())
SPECTRUM = pa.struct([("frequencies", DOUBLES), ("power", DOUBLES), ("dominant_frequency", pa.float64()), ("peak_power", pa.float64())])


def records(freqs: np.ndarray, power: np.ndarray) -> list[dict]:
    """A spectrum record for each row of ``power``; the dominant bin is the largest but the first."""
    f, out = freqs.tolist(), []
    peak = power[:, 1:].argmax(axis=1) + 1 if power.shape[1] > 1 else None
    for i, p in enumerate(power):
        k = None if peak is None else int(peak[i])
        out.append({"frequencies": f, "power": p.tolist(), "dominant_frequency": None if k is None else f[k], "peak_power": None if k is None else float(p[k])})
    return out


def relative(power: np.ndarray) -> np.ndarray:
    """Each row over its largest value, where that is positive and finite."""
    top = power.max(axis=1, keepdims=True)
    return np.where((top > 0) & np.isfinite(top), power / np.where(top > 0, top, 1.0), power)


class Spectrum(Frame):
    type = SPECTRUM
    #: Whether the window is rounded up to a power of two.
    rounded = True

    def __init__(self, window: int, update_every: int):
        positive("window", window)
        super().__init__(nx.power_of_two(window) if self.rounded else window, update_every)

    def grid(self, n: int | None = None) -> np.ndarray:
        n = n or self.window
        return np.arange(n // 2 + 1) / n


class Periodogram(Spectrum):
    """Power density of one tapered window."""

    running = False

    def __init__(self, window: int = 256, update_every: int = 16, fs: float = 1.0, window_type: str = "hann"):
        super().__init__(window, update_every)
        if fs <= 0:
            raise ValueError("fs must be positive")
        self.fs, self.taper = fs, nx.taper(window_type, self.window)

    def begin(self) -> dict | None:
        return {"n": 0, "sum": 0.0} if self.running else None

    def density(self, x: np.ndarray) -> np.ndarray:
        raw = np.abs(np.fft.rfft(x * self.taper, axis=1)) ** 2
        return nx.one_sided(self.window) * raw / (self.fs * max((self.taper**2).sum(), 1e-30))

    def compute(self, own: dict, x: np.ndarray) -> list[dict]:
        power = self.density(x)
        if self.running:
            total = own["sum"] + np.cumsum(power, axis=0)
            power = total / (own["n"] + np.arange(1, len(x) + 1))[:, None]
            own["n"], own["sum"] = own["n"] + len(x), total[-1]
        return records(self.grid() * self.fs, power)


class FftSpectralDensity(Periodogram):
    pass


class WelchPsd(Periodogram):
    """Mean density over every window so far; nothing is forgotten."""

    running = True


class BartlettMethod(WelchPsd):
    pass


class CrossSpectrum(Periodogram):
    """Magnitude of the mean cross spectrum of two channels over every window so far."""

    def begin(self) -> dict:
        return {"n": 0, "xy": 0.0, "xx": 0.0, "yy": 0.0}

    def sums(self, own: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        a, b = (np.fft.rfft(v * self.taper, axis=1) for v in (x, y))
        scale = nx.one_sided(self.window) / (self.fs * max((self.taper**2).sum(), 1e-30))
        new = {"xy": a * b.conj(), "xx": np.abs(a) ** 2, "yy": np.abs(b) ** 2}
        out = {k: own[k] + np.cumsum(scale * v, axis=0) for k, v in new.items()}
        own.update({k: v[-1] for k, v in out.items()})
        out["n"] = (own["n"] + np.arange(1, len(x) + 1))[:, None]
        own["n"] += len(x)
        return out

    def compute(self, own: dict, x: np.ndarray, y: np.ndarray) -> list[dict]:
        s = self.sums(own, x, y)
        return records(self.grid() * self.fs, np.abs(s["xy"] / s["n"]))


def coherent(xy: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    both = xx * yy
    return np.where(both > 1e-30, np.clip(np.abs(xy) ** 2 / np.where(both > 1e-30, both, 1.0), 0, 1), 0.0)


class Coherence(CrossSpectrum):
    def compute(self, own: dict, x: np.ndarray, y: np.ndarray) -> list[dict]:
        s = self.sums(own, x, y)
        return records(self.grid() * self.fs, coherent(s["xy"], s["xx"], s["yy"]))


class PartialCoherence(Spectrum):
    """Coherence of one segment after taking a first-order regression off either channel: one wherever it is defined."""

    def __init__(self, window: int = 64, update_every: int = 16):
        super().__init__(window, update_every)

    @staticmethod
    def left(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < 2:
            return x
        a, b = x[:, :-1], x[:, 1:]
        m = a.shape[1]
        den = m * (a * a).sum(axis=1) - a.sum(axis=1) ** 2
        top = m * (a * b).sum(axis=1) - a.sum(axis=1) * b.sum(axis=1)
        slope = np.where(np.abs(den) > 1e-12, top / np.where(np.abs(den) > 1e-12, den, 1.0), 0.0)
        return np.concatenate([x[:, :1], b - slope[:, None] * a], axis=1)

    def compute(self, own: Any, x: np.ndarray, y: np.ndarray) -> list[dict]:
        a, b = (np.fft.rfft(self.left(v) * nx.taper("hann", self.window), axis=1) for v in (x, y))
        return records(self.grid(), coherent(a * b.conj(), np.abs(a) ** 2, np.abs(b) ** 2))


class Goertzel(Kernel):
    """Power at chosen frequencies of each block of rows."""

    type = SPECTRUM

    def __init__(self, frequencies: Sequence[float], block: int = 64):
        if not len(frequencies):
            raise ValueError("frequencies are needed")
        self.freqs, self.block = np.array(frequencies, float), positive("block", block, 2)

    def start(self) -> np.ndarray:
        return np.empty(0)

    def step(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        data, n = np.concatenate([state, x]), len(x)
        full = len(data) // self.block
        blocks = data[: full * self.block].reshape(full, self.block)
        power = np.abs(blocks @ np.exp(-1j * TAU * np.outer(np.arange(self.block), self.freqs))) ** 2 / self.block**2
        out: list = [None] * n
        for i, rec in enumerate(records(self.freqs, power)):
            out[(i + 1) * self.block - len(state) - 1] = rec
        return data[full * self.block :], out


class ArSpectrum(Spectrum):
    """Autoregressive spectrum by Burg's method."""

    rounded = False

    def __init__(self, window: int = 128, order: int = 16, nfft: int = 128, update_every: int = 32):
        super().__init__(window, update_every)
        self.order, self.nfft = positive("order", order), nx.power_of_two(nfft)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        a, _ = nx.burg(x, self.order)
        acf = nx.autocorrelation(x, self.order)
        spread = np.maximum(acf[:, 0] - (a * acf[:, 1:]).sum(axis=1), 1e-18)
        freqs = self.grid(self.nfft)
        return records(freqs, spread[:, None] / np.maximum(nx.response(-a, freqs), 1e-18))


class ModifiedCovarianceArSpectrum(Spectrum):
    """Autoregression fitted forwards and backwards at once."""

    rounded = False

    def __init__(self, window: int = 64, order: int = 4, nfft: int = 128, update_every: int = 16):
        super().__init__(window, update_every)
        self.order, self.nfft = positive("order", order), max(64, int(nfft))

    def fit(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        p = self.order
        runs = np.lib.stride_tricks.sliding_window_view(x, p + 1)
        past = np.concatenate([runs[:, p - 1 :: -1] if p > 1 else runs[:, :1], runs[:, 1:]])
        now = np.concatenate([runs[:, p], runs[:, 0]])
        a = nx.solve(past.T @ past, -past.T @ now)
        acf = nx.autocorrelation(x, p)
        if a is None:  # then the predictor's coefficients stand, with their own sign
            return nx.levinson(acf, p)[0][0], max(float(acf[0]), 1e-18)
        return a, max(float(acf[0] + a @ acf[1:]), 1e-18)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        freqs = np.arange(self.nfft // 2 + 1) / self.nfft
        fits = [self.fit(v) for v in x]
        return records(freqs, np.stack([s / np.maximum(nx.response(a, freqs), 1e-18) for a, s in fits]))


class BlackmanTukey(Spectrum):
    """Transform of the autocorrelation under a triangular lag window."""

    rounded = False

    def __init__(self, window: int = 128, max_lag: int = 32, update_every: int = 32):
        super().__init__(window, update_every)
        self.lags = positive("max_lag", max_lag)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n = nx.power_of_two(2 * self.lags)
        weighed = nx.autocorrelation(x, self.lags) * (1 - np.arange(self.lags + 1) / (self.lags + 1.0))
        around = np.zeros((len(x), n))
        around[:, : self.lags + 1] = weighed
        around[:, n - self.lags :] = weighed[:, :0:-1]
        return records(self.grid(n), np.maximum(np.fft.rfft(around, axis=1).real, 0.0))


class MultitaperPsd(Spectrum):
    def __init__(self, window: int = 256, nw: float = 3.0, tapers: int = 5, update_every: int = 32):
        super().__init__(window, update_every)
        self.nw, self.tapers = nw, positive("tapers", tapers)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        each = [np.abs(np.fft.rfft(x * t, axis=1)) ** 2 for t in nx.slepian(self.window, self.nw, self.tapers)]
        return records(self.grid(), nx.one_sided(self.window) * sum(each) / self.tapers)


class MultipleCoherence(MultitaperPsd):
    """Multitaper coherence of two channels."""

    def __init__(self, window: int = 64, nw: float = 3.0, tapers: int = 4, update_every: int = 32):
        super().__init__(window, nw, tapers, update_every)

    def compute(self, own: Any, x: np.ndarray, y: np.ndarray) -> list[dict]:
        xx = yy = xy = 0.0
        for t in nx.slepian(self.window, self.nw, self.tapers):
            a, b = np.fft.rfft(x * t, axis=1), np.fft.rfft(y * t, axis=1)
            xx, yy, xy = xx + np.abs(a) ** 2, yy + np.abs(b) ** 2, xy + a * b.conj()
        s = nx.one_sided(self.window)
        return records(self.grid(), coherent(s * xy, s * xx, s * yy))


class CepstralAnalysis(Spectrum):
    """Real cepstrum, over the length once more."""

    def __init__(self, window: int = 64, update_every: int = 16):
        super().__init__(window, update_every)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n = self.window
        log = np.log(np.maximum(np.abs(np.fft.fft(x, axis=1)), 1e-12))
        return records(np.arange(n) / n, np.fft.ifft(log, axis=1).real / n)


class SpectralEnvelope(Spectrum):
    """Spectrum smoothed by keeping the first cepstral coefficients."""

    def __init__(self, window: int = 64, cepstral_order: int = 8, update_every: int = 16):
        super().__init__(window, update_every)
        self.order = positive("cepstral_order", cepstral_order)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n = self.window
        keep = max(1, min(self.order, n // 2))
        log = np.log(np.maximum(np.abs(np.fft.fft(x, axis=1)), 1e-12))
        lifted = np.fft.ifft(log, axis=1)
        lifted[:, keep : n - keep] = 0.0
        return records(self.grid(), np.exp(np.fft.fft(lifted, axis=1).real[:, : n // 2 + 1]))


class DaniellPeriodogram(Spectrum):
    """Periodogram smoothed over m bins to either side."""

    def __init__(self, window: int = 64, m: int = 3, update_every: int = 16):
        super().__init__(window, update_every)
        self.m = positive("m", m)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        raw = nx.one_sided(self.window) * np.abs(np.fft.rfft(x, axis=1)) ** 2 / self.window
        bins = raw.shape[1]
        near = (np.abs(np.arange(bins)[:, None] - np.arange(bins)[None, :]) <= self.m).astype(float)
        return records(self.grid(), raw @ near / near.sum(axis=0))


class ParzenPeriodogram(Spectrum):
    def __init__(self, window: int = 64, update_every: int = 16):
        super().__init__(window, update_every)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n = self.window
        w = nx.parzen((np.arange(n) - n / 2) / (n / 2))
        return records(self.grid(), nx.one_sided(n) * np.abs(np.fft.rfft(x * w, axis=1)) ** 2 / (w**2).sum())


class MultivariateSpectralAnalysis(Spectrum):
    """Sum of the spectra of delayed copies of the window."""

    def __init__(self, window: int = 64, embedding: int = 3, nfft: int = 64, update_every: int = 16):
        super().__init__(window, update_every)
        self.embedding, self.nfft = positive("embedding", embedding), nx.power_of_two(max(nfft, self.window))

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        each = (np.abs(np.fft.rfft(x[:, i:], self.nfft, axis=1)) ** 2 for i in range(min(self.embedding, self.window)))
        return records(self.grid(self.nfft), nx.one_sided(self.nfft) * sum(each) / self.nfft)


# ---------------------------------------------------------------- subspace methods


#: Windows whose matrices are turned together.
TURNED = 512


class Subspace(Spectrum):
    """Spectra over the whole circle k / nfft from a matrix of each window, relative to their largest value."""

    rounded = False

    def __init__(self, window: int = 64, n_sources: int = 2, nfft: int = 128, update_every: int = 16):
        super().__init__(window, update_every)
        self.sources, self.nfft = positive("n_sources", n_sources), max(64, int(nfft))
        if self.sources >= window:
            raise ValueError("n_sources must be below window")
        self.circle, self.turn = np.arange(self.nfft) / self.nfft, None

    def size(self) -> int:
        return min(max(self.window // 2, 2 * self.sources), self.window - 1)

    def matrices(self, x: np.ndarray) -> np.ndarray | None:
        """The matrix of each window whose vectors ``one`` takes; None where it takes none."""
        p = self.size()
        return nx.toeplitz(nx.autocorrelation(x, p), p)

    def gains(self, filters: np.ndarray) -> np.ndarray:
        """|A(f)|^2 summed over the columns of ``filters``."""
        if self.turn is None or self.turn.shape[1] != len(filters):
            self.turn = np.exp(-1j * TAU * np.outer(self.circle, np.arange(len(filters))))
        return (np.abs(self.turn @ filters) ** 2).sum(axis=1)

    def near_poles(self, poles: np.ndarray) -> np.ndarray:
        away = np.exp(1j * TAU * self.circle)[:, None] - poles[None, :]
        return (1.0 / np.maximum(np.abs(away) ** 2, 1e-30)).sum(axis=1)

    def one(self, x: np.ndarray, v: np.ndarray | None) -> np.ndarray | None:
        """The spectrum of a window, given the vectors of its matrix."""
        raise NotImplementedError

    def compute(self, own: Any, x: np.ndarray) -> list[dict | None]:
        every: list[np.ndarray | None] = []
        for k in range(0, len(x), TURNED):  # the matrices of so many windows are turned together
            some = x[k : k + TURNED]
            m = self.matrices(some)
            every += map(self.one, some, [None] * len(some) if m is None else nx.rotated_eigen(m, 200))
        got = [p for p in every if p is not None]
        done = iter(records(self.circle, relative(np.stack(got)))) if got else iter(())
        return [None if p is None else next(done) for p in every]


class MusicSpectrum(Subspace):
    def one(self, x: np.ndarray, v: np.ndarray) -> np.ndarray | None:
        noise = v[:, self.sources :]
        if not noise.shape[1]:
            return None
        g = self.gains(noise)
        return np.where(g > 1e-30, 1.0 / np.maximum(g, 1e-30), 1e30)


class PisarenkoSpectrum(Subspace):
    def size(self) -> int:
        return min(max(self.sources + 1, 2), self.window - 1)

    def one(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return 1.0 / np.maximum(self.gains(v[:, -1:]), 1e-30)


class MinimumNormSpectrum(Subspace):
    def size(self) -> int:
        return min(max(2 * self.sources, 2), self.window - 1)

    def one(self, x: np.ndarray, v: np.ndarray) -> np.ndarray | None:
        noise = v[:, self.sources :]
        first = noise @ noise[0] if noise.shape[1] else np.zeros(1)
        if abs(first[0]) < 1e-30:
            return None
        return 1.0 / np.maximum(self.gains((first / first[0])[:, None]), 1e-30)


def small_eigenvalues(m: np.ndarray) -> np.ndarray:
    """Eigenvalues of a 1x1 or 2x2 matrix; of a larger one real ones by power iteration and symmetric deflation, eight at most."""
    if len(m) <= 2:
        return np.linalg.eigvals(m).astype(complex)
    out, m = [], m.copy()
    for _ in range(min(len(m), 8)):
        v = np.sin(np.arange(len(m)) + 1.0)
        v, value = v / np.linalg.norm(v), 0.0
        for _ in range(100):
            new = m @ v
            norm = np.linalg.norm(new)
            if norm < 1e-30:
                break
            value, v = float(new @ v), new / norm
        out.append(value)
        m -= value * np.outer(v, v)
    return np.array(out, complex)


class EspritSpectrum(Subspace):
    def one(self, x: np.ndarray, v: np.ndarray) -> np.ndarray | None:
        v = v[:, : self.sources]
        if len(v) < 2:
            return None
        phi = nx.solve(v[:-1].T @ v[:-1], v[:-1].T @ v[1:])
        return None if phi is None else self.near_poles(small_eigenvalues(phi))


class MatrixPencilSpectrum(Subspace):
    def matrices(self, x: np.ndarray) -> np.ndarray | None:
        l = self.window // 2
        if not l:
            return None
        a = np.lib.stride_tricks.sliding_window_view(x, l, axis=1)[:, : self.window - l]
        return a.transpose(0, 2, 1) @ a

    def one(self, x: np.ndarray, v: np.ndarray | None) -> np.ndarray | None:
        l = self.window // 2
        rows = self.window - l
        if v is None or not rows:
            return None
        runs = np.lib.stride_tricks.sliding_window_view(x, l)
        a, b = runs[:rows], runs[1 : rows + 1]
        v = v[:, : min(self.sources, l)]
        phi = nx.solve(v.T @ a.T @ a @ v, v.T @ a.T @ b @ v)
        return None if phi is None else self.near_poles(small_eigenvalues(phi))


class EigenvectorFrequencyEstimator(Subspace):
    def __init__(self, window: int = 64, order: int = 4, nfft: int = 128, update_every: int = 16):
        super().__init__(window, order, nfft, update_every)

    def size(self) -> int:
        return self.sources + 1

    def one(self, x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return 1.0 / np.maximum(self.gains(v[:, -1:]), 1e-30)


class CaponSpectrum(Subspace):
    def __init__(self, window: int = 64, ar_order: int = 16, nfft: int = 128, update_every: int = 16):
        super().__init__(window, ar_order, nfft, update_every)

    def matrices(self, x: np.ndarray) -> None:
        return None

    def one(self, x: np.ndarray, v: None) -> np.ndarray | None:
        p = self.sources
        inverse = nx.solve(nx.toeplitz(nx.autocorrelation(x, p), p), np.eye(p))
        if inverse is None:
            return None
        turn = np.exp(1j * TAU * np.outer(self.circle, np.arange(p)))
        den = np.einsum("ki,ij,kj->k", turn.conj(), inverse, turn).real
        return np.where(den > 1e-30, 1.0 / np.where(den > 1e-30, den, 1.0), 0.0)


class PronySpectrum(Subspace):
    """Response of the Yule-Walker autoregression."""

    def matrices(self, x: np.ndarray) -> None:
        return None

    def one(self, x: np.ndarray, v: None) -> np.ndarray | None:
        p = self.sources
        acf = nx.autocorrelation(x, p)
        a = nx.solve(nx.toeplitz(acf, p), -acf[1:])
        return None if a is None else 1.0 / np.maximum(nx.response(a, self.circle), 1e-30)


class ApesSpectrum(Spectrum):
    """Minimum-variance spectrum of the forward-backward covariance, relative to its largest value."""

    rounded = False

    def __init__(self, window: int = 64, order: int = 4, nfft: int = 128, update_every: int = 16):
        super().__init__(window, update_every)
        self.order, self.nfft = positive("order", order), max(64, int(nfft))
        if order >= window:
            raise ValueError("order must be below window")

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        p, freqs, out = self.order, np.arange(self.nfft // 2 + 1) / self.nfft, []
        turn = np.exp(1j * TAU * np.outer(freqs, np.arange(p)))
        for v in x:
            runs = np.lib.stride_tricks.sliding_window_view(v, p)
            r = (runs.T @ runs + runs[:, ::-1].T @ runs[:, ::-1]) / (2 * len(runs))
            inverse = nx.solve(r, np.eye(p))
            inverse = np.eye(p) if inverse is None else inverse
            out.append(1.0 / np.maximum(np.einsum("ki,ij,kj->k", turn.conj(), inverse, turn).real, 1e-12))
        return records(freqs, relative(np.stack(out)))


def spectral_shape(spectrum: Column) -> Column:
    """Centroid, bandwidth, entropy, 85 % rolloff, flatness and dominant frequency of a spectrum record, as an expression."""
    f, p = spectrum["frequencies"], spectrum["power"]
    n, zero = F.size(p), F.lit(0.0)
    total = F.aggregate(p, zero, lambda a, x: a + x)
    safe = F.when(total > 0, total)
    centroid = F.coalesce(F.aggregate(F.zip_with(f, p, lambda a, b: a * b), zero, lambda a, x: a + x) / safe, zero)
    spread = F.aggregate(F.zip_with(f, p, lambda a, b: (a - centroid) * (a - centroid) * b), zero, lambda a, x: a + x) / safe
    share = F.transform(p, lambda x: F.when(x / safe > 0, -(x / safe) * F.ln(x / safe)).otherwise(zero))
    entropy = F.when(n > 1, F.aggregate(share, zero, lambda a, x: a + x) / F.ln(n.cast("double")))
    start = F.struct(zero.alias("sum"), F.lit(0).alias("below"))
    passed = F.aggregate(p, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["below"] + F.when(a["sum"] + x < 0.85 * total, 1).otherwise(0)).alias("below")))
    rolloff = F.when(total > 0, F.try_element_at(f, passed["below"] + 1))
    geometric = F.exp(F.aggregate(F.transform(p, F.ln), zero, lambda a, x: a + x) / n)
    flat = F.when(F.forall(p, lambda x: x > 0) & (total > 0), geometric / (total / n))
    out = {"centroid": centroid, "bandwidth": F.coalesce(F.sqrt(spread), zero), "entropy": F.coalesce(entropy, zero), "rolloff": F.coalesce(rolloff, zero), "flatness": F.coalesce(flat, zero), "dominant_frequency": F.coalesce(spectrum["dominant_frequency"], zero)}
    return F.when(spectrum.isNotNull(), F.struct(*[v.alias(k) for k, v in out.items()]))


ALL = {
    g.__name__: g
    for g in (
        Periodogram, FftSpectralDensity, WelchPsd, BartlettMethod, CrossSpectrum, Coherence, PartialCoherence, Goertzel, ArSpectrum, ModifiedCovarianceArSpectrum,
        BlackmanTukey, MultitaperPsd, MultipleCoherence, CepstralAnalysis, SpectralEnvelope, DaniellPeriodogram, ParzenPeriodogram, MultivariateSpectralAnalysis,
        MusicSpectrum, PisarenkoSpectrum, MinimumNormSpectrum, EspritSpectrum, MatrixPencilSpectrum, EigenvectorFrequencyEstimator, CaponSpectrum, PronySpectrum, ApesSpectrum,
    )
}
