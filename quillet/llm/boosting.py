"""Gradient-boosted regression trees for two classes, by histograms of binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Logistic loss, complete trees of a fixed depth stored as arrays, so that prediction is a few array operations a tree."""

    def __init__(self, trees: int = 100, depth: int = 4, rate: float = 0.3, least: float = 8.0, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.least, self.ridge = trees, depth, rate, least, ridge
        self.edges: np.ndarray = np.zeros((0, 0))
        self.base = 0.0
        self.feature = np.zeros((0, 0), np.int32)
        self.cut = np.zeros((0, 0))
        self.value = np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """x (rows, features), y of 0 and 1. With one class only, that class is all the model knows; without rows, neither."""
        n, k = x.shape
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)))[:-1] for j in range(k)]
        told = [j for j, e in enumerate(edges) if len(e)]  # features that differ between rows
        bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in told], axis=0)
        # of a feature with two values only the rows of the larger are counted
        ones = [np.flatnonzero(b) if len(edges[j]) == 1 else None for j, b in zip(told, bins, strict=True)]
        raw = np.full(n, self.base)
        trees = [self._tree(bins, ones, [edges[j] for j in told], np.array(told), *self._gradients(raw, y), raw) for _ in range(self.n_trees)]
        self.feature, self.cut, self.value = (np.stack(z) for z in zip(*trees, strict=True))
        return self

    @staticmethod
    def _gradients(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    def _tree(self, bins: np.ndarray, ones: list[np.ndarray | None], edges: list[np.ndarray], names: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
        """One tree over all rows, added to raw: feature and cut of every inner node, value of every leaf, by heap number."""
        k, n = bins.shape
        feature, cut = np.zeros((1 << self.depth) - 1, np.int32), np.full((1 << self.depth) - 1, np.inf)
        node, first = np.zeros(n, np.int64), 0
        for level in range(self.depth):
            width = 1 << level
            g, h = (np.zeros((k, width, BINS)) for _ in range(2))
            g[:, :, 0], h[:, :, 0] = np.bincount(node, gradient, width), np.bincount(node, hessian, width)
            for j, rows in enumerate(ones):
                if rows is not None:
                    for sums, of in ((g, gradient), (h, hessian)):
                        sums[j, :, 1] = np.bincount(node[rows], of[rows], width)
                        sums[j, :, 0] -= sums[j, :, 1]
                    continue
                at = node * BINS + bins[j]
                g[j] = np.bincount(at, gradient, width * BINS).reshape(width, BINS)
                h[j] = np.bincount(at, hessian, width * BINS).reshape(width, BINS)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
            small = (left_h < self.least / 4) | (all_h - left_h < self.least / 4)
            gain = np.where(small, 0, gain).transpose(1, 0, 2).reshape(width, -1)
            best = gain.argmax(1)
            j, at = best // BINS, best % BINS
            split = gain[np.arange(width), best] > 1e-9
            feature[first : first + width] = names[j]
            cut[first : first + width] = [edges[a][b] if s and b < len(edges[a]) else np.inf for a, b, s in zip(j, at, split, strict=True)]
            right = split[node] & (bins[j[node], np.arange(n)] > at[node])
            node = 2 * node + right
            first += width
        leaves = 1 << self.depth
        value = self.rate * np.bincount(node, gradient, leaves) / (np.bincount(node, hessian, leaves) + self.ridge)
        raw += value[node]
        return feature, cut, value

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            raw += value[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-raw))
