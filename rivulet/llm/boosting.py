"""Gradient-boosted trees for two classes, small enough to train on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Depth-limited trees on binned features, fitted to the logistic loss."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    edges: list[np.ndarray] = field(default_factory=list)
    forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, cut and value by node
    base: float = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            feature, cut, value = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(1 << self.depth)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                local = node - first
                best = np.full(width, 1e-6)
                for j in range(b.shape[1]):
                    key = local * (BINS + 1) + b[:, j]
                    gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better], cut[first : first + width][better] = j, at[better]
                node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
            value = self.rate * gs / (hs + 1)
            self.forest.append((feature, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if not len(x):
            return np.empty(0)
        b = self._bin(x)
        rows, score, inner = np.arange(len(b)), np.full(len(b), self.base), (1 << self.depth) - 1
        for feature, cut, value in self.forest:
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            score += value[node - inner]
        return 1 / (1 + np.exp(-score))
