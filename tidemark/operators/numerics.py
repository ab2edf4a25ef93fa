"""Numerical pieces shared by the frame kernels. Arrays of windows have one window in each row."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TAU = 2.0 * np.pi


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


# Cosine-sum tapers by name, amplitudes of cos(0), -cos(x), cos(2x), -cos(3x).
TAPERS = {
    "rectangular": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
}
# Other spellings.
SPELLINGS = {"rect": "rectangular", "boxcar": "rectangular", "none": "rectangular", "hanning": "hann", "blackman-harris": "blackmanharris"}


def taper(name: str, n: int) -> np.ndarray:
    """A symmetric taper of n values."""
    plain = SPELLINGS.get(name.lower(), name.lower())
    if plain not in TAPERS:
        raise ValueError(f"unknown window type {name}")
    x = TAU * np.arange(n) / max(1, n - 1)
    return sum((-1) ** k * a * np.cos(k * x) for k, a in enumerate(TAPERS[plain]))


def parzen(t: np.ndarray) -> np.ndarray:
    """Parzen's weights of |t| in [0, 1]."""
    t = np.abs(t)
    return np.where(t <= 0.5, 1 - 6 * t**2 + 6 * t**3, np.where(t <= 1, 2 * (1 - t) ** 3, 0.0))


def one_sided(n: int) -> np.ndarray:
    """2 for every bin of a real spectrum but the first and the last."""
    scale = np.full(n // 2 + 1, 2.0)
    scale[0] = scale[n // 2] = 1.0
    return scale


def autocorrelation(x: np.ndarray, order: int) -> np.ndarray:
    """Lags 0..order of each row, the mean taken off, divided by the length; lags beyond the row are 0."""
    d = x - x.mean(axis=-1, keepdims=True)
    n = x.shape[-1]
    out = np.zeros((*x.shape[:-1], order + 1))
    for lag in range(min(order, n - 1) + 1):
        out[..., lag] = (d[..., lag:] * d[..., : n - lag]).sum(axis=-1) / n
    return out


def toeplitz(acf: np.ndarray, n: int) -> np.ndarray:
    at = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
    return acf[..., at]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The solution of a x = b, or None where a pivot vanishes."""
    try:
        x = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return x if np.isfinite(x).all() else None


def rotated_eigen(a: np.ndarray, rotations: int) -> np.ndarray:
    """Of each matrix along the first axis: vectors (columns, by falling value, ties as they stand) after at most ``rotations`` plane rotations, each at the largest element above the diagonal.

    That is few for a large matrix, and the result then is far from its eigenvectors; it is what the operators are defined by. All
    matrices turn together, each in a plane of its own.
    """
    m = a.astype(float).reshape(-1, *a.shape[-2:]).copy()
    many, n, _ = m.shape
    v = np.repeat(np.eye(n)[None], many, axis=0)
    place = np.arange(n)
    size = np.where(place[:, None] < place[None, :], np.abs(m), -1.0)
    for _ in range(rotations if n > 1 else 0):
        at = size.reshape(many, -1).argmax(axis=1)
        r = np.flatnonzero(size.reshape(many, -1)[np.arange(many), at] >= 1e-14)
        if not len(r):
            break
        p, q = np.divmod(at[r], n)
        theta = (m[r, q, q] - m[r, p, p]) / (2.0 * m[r, p, q])
        t = 1.0 / (theta + np.copysign(np.hypot(1.0, theta), np.where(theta == 0, 1.0, theta)))
        c = (1.0 / np.hypot(1.0, t))[:, None]
        s = t[:, None] * c
        for x in (m, v):
            left, right = x[r, :, p], x[r, :, q]
            x[r, :, p], x[r, :, q] = c * left - s * right, s * left + c * right
        upper, lower = m[r, p], m[r, q]
        m[r, p], m[r, q] = c * upper - s * lower, s * upper + c * lower
        m[r, p, q] = m[r, q, p] = 0.0
        for k in (p, q):
            size[r, k] = np.where(place > k[:, None], np.abs(m[r, k]), -1.0)
            size[r, :, k] = np.where(place < k[:, None], np.abs(m[r, :, k]), -1.0)
    order = np.argsort(-np.diagonal(m, axis1=1, axis2=2), axis=1, kind="stable")
    v = np.take_along_axis(v, order[:, None, :], axis=2)
    return v if a.ndim == 3 else v[0]


@lru_cache(16)
def slepian(n: int, nw: float, count: int) -> np.ndarray:
    """``count`` tapers of n values from the concentration kernel, by 100 rotations; the largest entry of each is positive."""
    d = np.arange(n)[:, None] - np.arange(n)[None, :]
    kernel = np.where(d == 0, 2 * nw / n, np.sin(TAU * nw / n * d) / (np.pi * np.where(d == 0, 1, d)))
    v = rotated_eigen(kernel, 100)[:, :count].T
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    top = len(v[0]) - 1 - np.abs(v[:, ::-1]).argmax(axis=1)  # the last of equal ones
    return v * np.where(v[np.arange(len(v)), top] < 0, -1.0, 1.0)[:, None]


def levinson(acf: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Predictor coefficients (x_t = sum a_i x_{t-i}), error variance and reflections, for autocorrelations in rows."""
    acf = np.atleast_2d(acf)
    rows = len(acf)
    a, k = np.zeros((rows, order)), np.zeros((rows, order))
    error = acf[:, 0].copy() if acf.shape[1] else np.zeros(rows)
    live = error > 0
    for m in range(1, min(order, acf.shape[1] - 1) + 1):
        rest = acf[:, m] - (a[:, : m - 1] * acf[:, m - 1 : 0 : -1]).sum(axis=1)
        step = np.where(live, rest / np.where(live, error, 1.0), 0.0)
        turned = a[:, : m - 1] - step[:, None] * a[:, : m - 1][:, ::-1]
        a[:, : m - 1] = np.where(live[:, None], turned, a[:, : m - 1])
        a[:, m - 1], k[:, m - 1] = step, step
        error = np.where(live, error * (1 - step**2), error)
        live &= error > 0
    return a, np.maximum(error, 0.0), k


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictor coefficients and reflections of each row by Burg's method; zeros where the row is not longer than the order."""
    x = np.atleast_2d(x)
    a, k = np.zeros((len(x), order)), np.zeros((len(x), order))
    if x.shape[1] <= order:
        return a, k
    ahead, back = x[:, 1:], x[:, :-1]
    for m in range(order):
        den = (ahead**2 + back**2).sum(axis=1)
        step = np.where(den > 1e-18, 2 * (ahead * back).sum(axis=1) / np.where(den > 1e-18, den, 1.0), 0.0)
        a[:, :m] = a[:, :m] - step[:, None] * a[:, :m][:, ::-1]
        a[:, m] = k[:, m] = step
        ahead, back = (ahead - step[:, None] * back)[:, 1:], (back - step[:, None] * ahead)[:, :-1]
    return a, k


def response(coefficients: np.ndarray, freqs: np.ndarray, lead: float = 1.0) -> np.ndarray:
    """|lead + sum c_i e^{-j w (i + 1)}|^2 at the frequencies, for coefficients in rows."""
    turn = np.exp(-1j * TAU * np.outer(np.arange(1, coefficients.shape[-1] + 1), freqs))
    return np.abs(lead + coefficients @ turn) ** 2


def haar(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and differences of neighbours over the root of two; an odd last value is left out."""
    even, odd = x[..., 0 : x.shape[-1] // 2 * 2 : 2], x[..., 1::2]
    return (even + odd) / np.sqrt(2.0), (even - odd) / np.sqrt(2.0)


def haar_levels(x: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The remaining sums, and the differences of each level, finest first."""
    details = []
    for _ in range(levels):
        if x.shape[-1] < 2:
            break
        x, d = haar(x)
        details.append(d)
    return x, details


def unhaar(x: np.ndarray, details: list[np.ndarray]) -> np.ndarray:
    for d in reversed(details):
        x = np.stack([x[..., : d.shape[-1]] + d, x[..., : d.shape[-1]] - d], axis=-1).reshape(*d.shape[:-1], -1) / np.sqrt(2.0)
    return x


def circular_details(x: np.ndarray, levels: int, ahead: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Halved sums and differences with the value 1, 2, 4, ... back (or ahead), around the ends."""
    details = []
    for j in range(levels):
        other = np.roll(x, -(1 << j) if ahead else 1 << j, axis=-1)
        details.append((x - other) / 2)
        x = (x + other) / 2
    return x, details


def wrapped(angle: np.ndarray) -> np.ndarray:
    """Differences of two angles brought to [-pi, pi]."""
    return np.where(angle > np.pi, angle - TAU, np.where(angle < -np.pi, angle + TAU, angle))


def upper_median(x: np.ndarray) -> np.ndarray:
    return np.sort(x, axis=-1)[..., x.shape[-1] // 2]


def deviation(x: np.ndarray) -> np.ndarray:
    """Median absolute deviation from the upper median, scaled to a normal's deviation."""
    return upper_median(np.abs(x - upper_median(x)[..., None])) / 0.6745


def shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by[..., None], 0.0)
