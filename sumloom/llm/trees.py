"""Gradient-boosted trees on a dense matrix, and isotonic calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Boosted depth-limited trees for a 0/1 target under logistic loss. A tree is complete: node i
    has children 2i+1 and 2i+2; a node that doesn't split sends every row left."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5, ridge: float = 1.0) -> Boosted:
        n, d = x.shape
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        base = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        f = np.full(n, base)
        inner, leaves = 2**depth - 1, 2**depth
        feature, cut, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                local = node - first
                best = np.full(width, 1e-6)
                for j in range(d):
                    if not len(edges[j]):
                        continue
                    key, size = local * bins + binned[:, j], width * bins
                    gs, hs, cs = (np.bincount(key, weights=w, minlength=size).reshape(width, bins).cumsum(axis=1) for w in (g, h, np.ones(n)))
                    gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                    gr, hr, cr = gs[:, -1:] - gl, hs[:, -1:] - hl, cs[:, -1:] - cl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + ridge)
                    gain[(cl < least) | (cr < least)] = -1
                    gain[:, len(edges[j]) :] = -1
                    at = gain.argmax(axis=1)
                    better = gain[np.arange(width), at] > best
                    best[better] = gain[np.arange(width), at][better]
                    feature[t, first : first + width][better] = j
                    cut[t, first : first + width][better] = edges[j][np.minimum(at, len(edges[j]) - 1)][better]
                node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
            at = node - inner
            leaf[t] = rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + ridge)
            f += leaf[t][at]
        return cls(base, feature, cut, leaf)

    def raw(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        out, rows = np.full(n, self.base), np.arange(n)
        inner = self.feature.shape[1]
        for t in range(len(self.leaf)):
            node = np.zeros(n, dtype=np.int64)
            while n and node[0] < inner:
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t][node - inner]
        return out


class Isotonic:
    """The non-decreasing least-squares fit of y over s (pool adjacent violators)."""

    def __init__(self, knots: np.ndarray, values: np.ndarray):
        self.knots, self.values = knots, values

    @classmethod
    def fit(cls, s: np.ndarray, y: np.ndarray) -> Isotonic:
        knots, at = np.unique(s, return_inverse=True)
        weight = np.bincount(at).astype(float)
        mean = np.bincount(at, weights=y) / weight
        blocks: list[list[float]] = []  # value, weight, number of knots
        for m, w in zip(mean, weight, strict=True):
            blocks.append([m, w, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, n2 = blocks.pop()
                m1, w1, n1 = blocks[-1]
                blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
        return cls(knots, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks]))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.interp(s, self.knots, self.values)
