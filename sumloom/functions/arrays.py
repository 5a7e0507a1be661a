"""Running and whole sums along the steps of [series, step], fast for arrays whose memory runs along the series.

A step of hundreds of series is one vector operation then, where NumPy adds the steps of a series one by
one. All results have the bits that NumPy gives for rows that lie one after the other.
"""

from __future__ import annotations

import numpy as np

#: Least number of series for which memory runs along them.
MANY = 128
#: Values of a dimension that are worked on at once, about: about what a core's cache holds.
BLOCK = 1 << 17


def along_series(x: np.ndarray) -> np.ndarray:
    """The same [series, dimension, step] or [series, step]; of many series, with memory along them."""
    return np.moveaxis(np.ascontiguousarray(np.moveaxis(x, 0, -1)), -1, 0) if x.shape[0] >= MANY else x


def _turned(z: np.ndarray) -> bool:
    return z.ndim == 2 and z.shape[0] > 1 and z.shape[1] > 0 and z.flags.f_contiguous and not z.flags.c_contiguous


def like(g: np.ndarray, z: np.ndarray) -> np.ndarray:
    """g, with memory as that of z."""
    return np.asfortranarray(g) if _turned(z) else g


def flat(z: np.ndarray) -> np.ndarray:
    """All values, in any order."""
    return z.ravel(order="K")


def running(op: np.ufunc, z: np.ndarray) -> np.ndarray:
    if not _turned(z):
        return op.accumulate(z, axis=1)
    out = np.empty_like(z)
    steps, made = z.T, out.T
    last = made[0]
    last[:] = steps[0]
    for step, now in zip(steps[1:], made[1:], strict=True):
        op(last, step, now)
        last = now
    return out


def _pairs(w: np.ndarray) -> np.ndarray:
    """Sums over the first axis in the order that NumPy takes for a row in memory."""
    n = len(w)
    if n < 8:
        out = w[0].copy()
        for r in w[1:]:
            out += r
        return out
    if n <= 128:
        r = w[: n - n % 8].reshape(n // 8, 8, -1).sum(axis=0)
        out = ((r[0] + r[1]) + (r[2] + r[3])) + ((r[4] + r[5]) + (r[6] + r[7]))
        for last in w[n - n % 8 :]:
            out += last
        return out
    half = n // 2 - n // 2 % 8
    return _pairs(w[:half]) + _pairs(w[half:])


def totals(z: np.ndarray) -> np.ndarray:
    return _pairs(z.T) + 0.0 if _turned(z) else z.sum(axis=1)


def counts(mask: np.ndarray) -> np.ndarray:
    if not _turned(mask):
        return np.count_nonzero(mask, axis=1)
    bits, out = mask.T.view(np.uint8), np.zeros(mask.shape[0], dtype=np.int64)
    for t in range(0, len(bits), 255):
        out += bits[t : t + 255].sum(axis=0, dtype=np.uint8)
    return out


def kept(mask: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y where the mask holds, else 0."""
    if y.dtype != np.float64 or mask.shape != y.shape:
        return np.where(mask, y, 0.0)
    ones = np.negative(mask.view(np.int8)).astype(np.int64)  # all bits or none
    return np.bitwise_and(y.view(np.int64), ones).view(np.float64)
