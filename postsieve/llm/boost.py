"""Gradient-boosted trees for two classes, on numpy: depth-limited trees over quantile bins, logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 16, least: float = 3.0, ridge: float = 1.0, share: float = 0.5):
        self.share = share  # of the rows and of the features that a tree sees
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        # every split of every feature is a column of indicators, so that one product has the sums of all splits of a level
        splits = [(j, e) for j, c in enumerate(x.T) for e in np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) if e < c.max()]
        above = np.stack([x[:, j] > e for j, e in splits]).astype(np.float32) if splits else np.zeros((0, len(y)), np.float32)
        f, rng, of = np.full(len(y), self.base), np.random.default_rng(0), np.array([j for j, _ in splits])
        for _ in range(self.rounds if splits else 0):
            q = 1 / (1 + np.exp(-f))
            seen, open_ = rng.random(len(y)) < self.share, (rng.random(x.shape[1]) < self.share)[of]
            f += self._grow(above, splits, (y - q) * seen, q * (1 - q) * seen, open_)
        return self

    def _grow(self, above: np.ndarray, splits: list[tuple[int, float]], grad: np.ndarray, hess: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Adds one tree, stored as arrays over a complete binary tree; returns its values on the training rows."""
        inner = (1 << self.depth) - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(inner + (1 << self.depth))
        node, row = np.zeros(len(grad), dtype=np.int64), np.arange(len(grad))
        value[0] = self.rate * grad.sum() / (hess.sum() + self.ridge)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            live = node >= first
            own = np.zeros((len(grad), 2 * width), dtype=np.float32)
            own[row[live], node[live] - first], own[row[live], node[live] - first + width] = grad[live], hess[live]
            right = above @ own
            g, h, g0, h0 = right[:, :width], right[:, width:], own[:, :width].sum(axis=0, dtype=np.float64), own[:, width:].sum(axis=0, dtype=np.float64)
            gain = g * g / (h + self.ridge) + (g0 - g) ** 2 / (h0 - h + self.ridge) - g0 * g0 / (h0 + self.ridge)
            gain[(h < self.least) | (h0 - h < self.least) | ~open_[:, None]] = 0
            for k, at in enumerate(gain.argmax(axis=0)):
                if gain[at, k] <= 1e-6:
                    continue
                parent = first + k
                feature[parent], cut[parent] = splits[at]
                for child, gs, hs in ((2 * parent + 1, g0[k] - g[at, k], h0[k] - h[at, k]), (2 * parent + 2, g[at, k], h[at, k])):
                    value[child] = self.rate * gs / (hs + self.ridge)
                rows = np.flatnonzero(node == parent)
                node[rows] = 2 * parent + 1 + (above[at, rows] > 0)
        self.trees.append((feature, cut, value))
        return value[node]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        f = np.full(len(x), self.base)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                inside = node < len(feature)
                j = np.where(inside, feature[np.minimum(node, len(feature) - 1)], -1)
                go = j >= 0
                right = x[at, np.maximum(j, 0)] > cut[np.minimum(node, len(cut) - 1)]
                node = np.where(go, 2 * node + 1 + right, node)
            f += value[node]
        return f
