"""Gradient-boosted trees for a yes-or-no label, over binned features."""

from __future__ import annotations

import numpy as np

BINS = 16


class Boosted:
    """Additive trees of fixed depth on log odds; level order arrays, node i has children 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, least: float = 4.0, ridge: float = 1.0):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], 1)
        wide, flat = x.shape[1], x.shape[1] * BINS
        cells = binned + np.arange(wide) * BINS
        share = y.mean()
        self.start = float(np.log(share / (1 - share)))
        self.depth, inner = depth, 2**depth - 1
        odds = np.full(len(y), self.start)
        feature, cut, leaf = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-odds))
            g, h = y - p, p * (1 - p)
            f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for level in range(depth):
                first, n = 2**level - 1, 2**level
                k = ((at - first)[:, None] * flat + cells).ravel()
                gl = np.bincount(k, np.repeat(g, wide), n * flat).reshape(n, wide, BINS).cumsum(2)
                hl = np.bincount(k, np.repeat(h, wide), n * flat).reshape(n, wide, BINS).cumsum(2)
                gr, hr = gl[..., -1:] - gl, hl[..., -1:] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[..., -1:] ** 2 / (hl[..., -1:] + ridge)
                gain[(hl < least) | (hr < least)] = 0
                gain = gain.reshape(n, flat)
                best = gain.argmax(1)
                which, where = np.divmod(best, BINS)
                where[gain[np.arange(n), best] <= 1e-6] = -1
                f[first : first + n] = which
                c[first : first + n] = [edges[j][b] if 0 <= b < len(edges[j]) else np.inf for j, b in zip(which, where, strict=True)]
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] >= c[at])
            k = at - inner
            v = rate * np.bincount(k, g, inner + 1) / (np.bincount(k, h, inner + 1) + ridge)
            odds += v[k]
            feature.append(f), cut.append(c), leaf.append(v)
        self.feature, self.cut, self.leaf = np.array(feature), np.array(cut), np.array(leaf)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] >= c[at])
            out += v[at - len(f)]
        return out
