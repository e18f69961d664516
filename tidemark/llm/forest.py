"""A small random forest: histogram splits by Gini impurity, bootstrap rows, random features."""

from __future__ import annotations

import numpy as np


class RandomForest:
    """Binary classifier over dense rows; a few thousand training rows fit in memory."""

    def __init__(self, trees: int = 24, depth: int = 8, bins: int = 32, least: int = 4, seed: int = 7):
        self.trees, self.depth, self.bins, self.least, self.seed = trees, depth, bins, least, seed

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> RandomForest:
        """weight: how often a row is to be drawn for a tree, on average (once if not given)."""
        rng = np.random.default_rng(self.seed)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        some = max(2, int(np.sqrt(x.shape[1]) + 1))
        self.forest = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(y), len(y)) if weight is None else rng.choice(len(y), int(weight.sum()), p=weight / weight.sum())
            nodes: list[list[float]] = []  # feature, bin, left, right, share of positives
            self._grow(binned[rows], y[rows], 0, some, rng, nodes)
            self.forest.append(np.array(nodes, np.float64))
        return self

    def _grow(self, b: np.ndarray, y: np.ndarray, depth: int, some: int, rng: np.random.Generator, nodes: list) -> int:
        node = len(nodes)
        nodes.append([-1, 0, 0, 0, (y.sum() + 0.5) / (len(y) + 1)])
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return node
        best = (1e-9, -1, -1)
        before = y.mean() * (1 - y.mean()) * len(y)
        for f in rng.permutation(b.shape[1])[:some]:
            width = len(self.cuts[f]) + 1
            n, k = np.bincount(b[:, f], minlength=width).cumsum()[:-1], np.bincount(b[:, f], y, width).cumsum()[:-1]
            n2, k2 = len(y) - n, y.sum() - k
            ok = (n >= self.least) & (n2 >= self.least)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, before - k * (1 - k / n) - k2 * (1 - k2 / n2), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], f, at)
        if best[1] >= 0:
            left = b[:, best[1]] <= best[2]
            nodes[node][:2] = best[1], best[2]
            nodes[node][2] = self._grow(b[left], y[left], depth + 1, some, rng, nodes)
            nodes[node][3] = self._grow(b[~left], y[~left], depth + 1, some, rng, nodes)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees."""
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        total = np.zeros(len(x))
        for nodes in self.forest:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                feature = nodes[at, 0].astype(np.int64)
                left = binned[np.arange(len(x)), np.maximum(feature, 0)] <= nodes[at, 1]
                at = np.where(feature < 0, at, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64))
            total += nodes[at, 4]
        return total / len(self.forest)
