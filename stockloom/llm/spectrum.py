"""Leading eigenpairs of a symmetric matrix by slicing its spectrum."""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(float).eps)
_ALPHA = (1 + math.sqrt(17)) / 8


def positives(a: np.ndarray) -> int:
    """Number of positive eigenvalues: those of D in a = LDLᵀ (Sylvester), with pivots of one or two rows chosen as Bunch and Kaufman do."""
    a, k, found = np.array(a, float), 0, 0
    n = len(a)
    while k < n:
        below = np.abs(a[k + 1 :, k])
        most, own, two = below.max(initial=0.0), abs(a[k, k]), False
        if not max(most, own):
            k += 1  # a zero pivot
            continue
        if own < _ALPHA * most:
            r = k + 1 + int(below.argmax())
            others = np.abs(a[r, k:])
            others[r - k] = 0
            far = others.max()
            if own * far < _ALPHA * most * most:
                two = abs(a[r, r]) < _ALPHA * far
                to = k + two
                if to != r:
                    a[[to, r], k:] = a[[r, to], k:]
                    a[k:, [to, r]] = a[k:, [r, to]]
        if two:
            d, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            det = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0]
            found += 1 if det < 0 else 2 * (d[0, 0] + d[1, 1] > 0)
            inverse = np.array([[d[1, 1], -d[0, 1]], [-d[1, 0], d[0, 0]]]) / det
            a[k + 2 :, k + 2 :] -= c @ inverse @ c.T
            k += 2
        else:
            found += a[k, k] > 0
            c = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            k += 1
    return int(found)


class Slices:
    """Counts of eigenvalues above shifts of v, each factored once."""

    def __init__(self, v: np.ndarray):
        self.v, self.known = v, {}
        self.scale = float(np.abs(v).sum(axis=1).max(initial=0))  # no eigenvalue is larger
        self.blur = 16 * max(1, len(v)) * _EPS * self.scale  # what rounding may move an eigenvalue by, with room

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positives(self.v - shift * np.eye(len(self.v)))
        return self.known[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The closest known shifts with at least k, and with fewer than k eigenvalues above."""
        return max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k)

    def solve(self, shift: float, x: np.ndarray) -> np.ndarray:
        try:
            y = np.linalg.solve(self.v - shift * np.eye(len(self.v)), x)
        except np.linalg.LinAlgError:
            y = np.full_like(x, np.inf)
        return y if np.isfinite(y).all() else np.linalg.solve(self.v - (shift + self.blur / 8) * np.eye(len(self.v)), x)


def leading(v: np.ndarray, most: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (at most `most`), falling, and unit eigenvectors as columns, whose largest component is positive.

    Bisection on inertia counts isolates the k-th eigenvalue between two shifts; Rayleigh quotient iteration from there converges
    cubically; it is taken if it stays between the shifts and the counts right below and above it are at least k and k - 1, which certifies its number.
    Eigenvalues that rounding cannot tell apart get an orthonormal basis of their space. Those that rounding cannot tell from zero are left out.
    """
    s, values, vectors = Slices(v), [], []
    if not s.scale:
        return np.zeros(0), np.zeros((len(v), 0))
    s.known[s.scale * (1 + 4 * _EPS) + s.blur] = 0
    wanted = min(most, s.above(s.blur))
    while len(values) < wanted:
        k = len(values) + 1
        pair = None
        while pair is None:
            lo, hi = s.around(k)
            several = s.above(lo) - s.above(hi)
            if hi - lo <= 4 * s.blur:
                pair = _space(s, (lo + hi) / 2, several)
            elif several > 1 or (pair := _refined(s, lo, hi, k)) is None:
                s.above((lo + hi) / 2)
        values += list(pair[0])
        vectors += list(pair[1].T)
    values, vectors = np.array(values[:wanted]), np.array(vectors[:wanted]).T
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)] if wanted else np.zeros(0)
    return values, vectors.reshape(len(v), wanted) * np.where(top < 0, -1.0, 1.0)


def _start(n: int, m: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((n, m)))[0]


def _refined(s: Slices, lo: float, hi: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The one eigenpair between lo and hi; None if the iteration leaves them."""
    x, shift, last = _start(len(s.v), 1, k)[:, 0], (lo + hi) / 2, math.inf
    for turn in range(12):
        y = s.solve(shift, x)
        x = y / np.linalg.norm(y)
        value = float(x @ s.v @ x)
        off = float(np.linalg.norm(s.v @ x - value * x))
        if not lo <= value <= hi:
            return None
        if off <= s.blur / 4 and off >= last / 2:  # no longer falling
            sure = s.above(value - s.blur) >= k and s.above(value + s.blur) == k - 1
            return (np.array([value]), x[:, None]) if sure else None
        shift, last = (value, off) if turn else (shift, off)  # one step at the middle, then Rayleigh quotients
    return None


def _space(s: Slices, middle: float, several: int) -> tuple[np.ndarray, np.ndarray]:
    """`several` eigenvalues at the middle: an orthonormal basis of their space, by inverse iteration of a block."""
    x = _start(len(s.v), several, 0)
    for _ in range(4):
        x = np.linalg.qr(s.solve(middle, x))[0]
    values = np.einsum("ij,ij->j", x, s.v @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]
