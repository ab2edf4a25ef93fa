"""Mode decompositions and blind separation of the last rows, on a cadence."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa

from ..plans.ordered import Frame
from . import numerics as nx
from .numerics import TAU
from .rolling import positive
from .spectral import DOUBLES

MODES = pa.struct([("coefficients", DOUBLES), ("n_modes", pa.int32()), ("mode_frequencies", DOUBLES)])


def modes(parts: list[np.ndarray], freqs: list[float]) -> dict:
    return {"coefficients": np.concatenate(parts).tolist() if parts else [], "n_modes": len(parts), "mode_frequencies": [float(f) for f in freqs]}


class Decomposition(Frame):
    type = MODES
    most = 16

    def __init__(self, window: int, count: int, update_every: int):
        super().__init__(positive("window", window), update_every)
        if not 1 <= count <= self.most:
            raise ValueError(f"the number of parts must lie in 1..{self.most}")
        self.count = int(count)


class VmdDecomposition(Decomposition):
    """Variational modes: alternating Wiener filters around centre frequencies that follow their power; all windows advance together."""

    sweeps, close = 50, 1e-6

    def __init__(self, window: int = 64, n_modes: int = 3, alpha: float = 2000.0, update_every: int = 16):
        super().__init__(window, n_modes, update_every)
        self.alpha = alpha

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        n, m, k = self.window, nx.power_of_two(self.window), self.count
        target, w = np.fft.fft(x, m, axis=1), np.fft.fftfreq(m)
        w[m // 2] = abs(w[m // 2])
        parts = np.zeros((k, len(x), m), complex)
        centre = np.repeat(((np.arange(k) + 0.5) / k * 0.5)[:, None], len(x), axis=1)
        live = np.arange(len(x))
        for _ in range(self.sweeps):
            own_parts, own_centre = parts[:, live], centre[:, live]
            for i in range(k):
                rest = target[live] - (own_parts.sum(axis=0) - own_parts[i])
                own_parts[i] = rest / (1 + 2 * self.alpha * (w - own_centre[i][:, None]) ** 2)
            power = np.abs(own_parts[:, :, : m // 2]) ** 2
            total = power.sum(axis=2)
            own_centre = np.where(total > 1e-30, (power @ (np.arange(m // 2) / m)) / np.where(total > 1e-30, total, 1.0), own_centre)
            parts[:, live], centre[:, live] = own_parts, own_centre
            left = np.abs(target[live] - own_parts.sum(axis=0)).max(axis=1) ** 2
            live = live[left >= self.close**2]
            if not len(live):
                break
        back = np.fft.ifft(parts, axis=2).real[:, :, :n] / m
        return [modes(list(back[:, t]), centre[:, t].tolist()) for t in range(len(x))]


# ---------------------------------------------------------------- sifting


def envelopes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear envelopes through the (weak) maxima and minima, flat beyond the outermost; zeros where either has fewer than two."""
    inner = np.arange(1, len(h) - 1)
    ends = [inner[(s * h[inner] >= s * h[inner - 1]) & (s * h[inner] >= s * h[inner + 1])] for s in (1, -1)]
    if len(h) < 3 or min(map(len, ends)) < 2:
        return np.zeros(len(h)), np.zeros(len(h))
    return tuple(np.interp(np.arange(len(h)), e, h[e]) for e in ends)  # type: ignore[return-value]


def extrema(h: np.ndarray) -> int:
    d = np.diff(h)
    return int((d[:-1] * d[1:] < 0).sum())


def crossings(h: np.ndarray) -> int:
    side = h >= 0
    return int((side[1:] != side[:-1]).sum())


class EmdDecomposition(Decomposition):
    """Empirical modes by at most ten siftings each."""

    def __init__(self, window: int = 64, max_imfs: int = 4, update_every: int = 16):
        super().__init__(window, max_imfs, update_every)

    def one(self, x: np.ndarray) -> dict:
        rest, parts, freqs = x.copy(), [], []
        while len(parts) < self.count and extrema(rest) > 2:
            h = rest
            for _ in range(10):
                up, down = envelopes(h)
                h = h - (up + down) / 2
                if abs(extrema(h) - crossings(h)) <= 1:
                    break
            parts.append(h)
            freqs.append(crossings(h) / (2 * len(x)))
            rest = rest - h
        return modes(parts, freqs)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        return [self.one(v) for v in x]


class LmdDecomposition(EmdDecomposition):
    """Local means: the frequency-modulated part is taken off, not its product with the envelope."""

    def __init__(self, window: int = 64, max_pfs: int = 4, update_every: int = 16):
        super().__init__(window, max_pfs, update_every)

    def one(self, x: np.ndarray) -> dict:
        rest, parts, freqs = x.copy(), [], []
        for _ in range(self.count):
            h, before = rest, None
            for _ in range(20):
                mean = sum(envelopes(h)) / 2
                h = h - mean
                top = envelopes(h)[0]
                h = np.where(top > 1e-10, h / np.where(top > 1e-10, top, 1.0), h)
                if before is not None and np.abs(mean - before).mean() < 1e-4:
                    break
                before = mean
            parts.append(h)
            freqs.append(crossings(h) / (2 * len(x)))
            rest = rest - h
            if extrema(rest) <= 2:
                break
        return modes(parts, freqs)


class MatchingPursuitDecomposition(Decomposition):
    """Gabor atoms of the largest correlation, taken off with its size whatever its sign."""

    most = 32

    def __init__(self, window: int = 64, n_atoms: int = 5, update_every: int = 16):
        super().__init__(window, n_atoms, update_every)
        n = self.window
        i, atoms, self.freqs = np.arange(n), [], []
        for k in range(1, 17):
            for sigma in (4.0, 8.0, 16.0, 32.0):
                atom = np.exp(-0.5 * ((i - n / 2) / sigma) ** 2) * np.cos(TAU * k / n * i) / max(np.sqrt(np.pi * sigma**2) * n, 1e-10)
                size = np.linalg.norm(atom)
                atoms.append(atom / size if size > 1e-10 else atom)
                self.freqs.append(k / n)
        self.atoms = np.stack(atoms)

    def compute(self, own: Any, x: np.ndarray) -> list[dict]:
        out = []
        for rest in x:
            parts, freqs = [], []
            for _ in range(self.count):
                match = np.abs(self.atoms @ rest)
                best = int(match.argmax())
                if match[best] < 1e-10:
                    break
                parts.append(match[best] * self.atoms[best])
                freqs.append(self.freqs[best])
                rest = rest - parts[-1]
            out.append(modes(parts, freqs))
        return out


class FastICA(Frame):
    """Independent components of centred channels by ten fixed-point steps; the weights pass from one recompute to the next."""

    type = pa.list_(DOUBLES)
    together = 1

    def __init__(self, n_signals: int = 2, n_components: int = 2, window: int = 64, update_every: int = 16):
        super().__init__(positive("window", window), update_every)
        if not 1 <= n_components <= n_signals <= 16:
            raise ValueError("1 <= n_components <= n_signals <= 16 must hold")
        self.signals, self.components = int(n_signals), int(n_components)

    def begin(self) -> dict:
        return {"w": np.eye(self.components, self.signals)}

    def compute(self, own: dict, x: np.ndarray) -> list:
        out = []
        for window in x:
            if window.shape[1] != self.signals:
                raise ValueError(f"{self.signals} signals are expected in each row")
            d, w = (window - window.mean(axis=0)).T, own["w"].copy()
            for _ in range(10):
                bent = np.tanh(w @ d)
                new = bent @ d.T / d.shape[1]
                slope = (1 - bent**2).mean(axis=1)
                new = np.where(slope[:, None] > 1e-10, new / np.where(slope > 1e-10, slope, 1.0)[:, None], new)
                for c in range(self.components):
                    for b in range(c):
                        new[c] -= (new[c] @ w[b]) * w[b]
                    size = np.linalg.norm(new[c])
                    w[c] = new[c] / size if size > 1e-10 else new[c]
            own["w"] = w
            out.append((w @ d).tolist())
        return out


ALL = {g.__name__: g for g in (VmdDecomposition, EmdDecomposition, LmdDecomposition, MatchingPursuitDecomposition, FastICA)}
