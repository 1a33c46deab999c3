"""Histogram gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees in arrays: ``feature`` and ``threshold`` (trees, 2**depth - 1), ``leaf`` (trees, 2**depth)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row: all rows go down each tree together, a level at a time."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, damping: float = 1.0, least: float = 4.0) -> Trees:
    """Fit on finite features ``x`` and labels ``y`` (0 or 1). Deterministic; without rows, or with one class only, no tree splits.

    Features are binned at quantiles; a level of a tree is grown from the histograms of gradient and curvature of all
    its nodes. ``least`` is the curvature that each child needs.
    """
    n, width = x.shape
    mean = (y.sum() + 1) / (n + 2)
    start = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if n == 0 or y.min() == y.max():
        return Trees(start, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin k: edge k-1 < x <= edge k
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(count)
            for f in range(width):
                key = local * bins + binned[:, f]
                g = np.bincount(key, grad, count * bins).reshape(count, bins).cumsum(1)
                h = np.bincount(key, curve, count * bins).reshape(count, bins).cumsum(1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + damping) + (all_g - g) ** 2 / (all_h - h + damping) - all_g**2 / (all_h + damping)
                gain[(h < least) | (all_h - h < least)] = 0
                gain[:, len(edges[f]) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[t, first : first + count][better] = f
                if better.any():
                    threshold[t, first : first + count][better] = edges[f][k[better]]
            rows = np.arange(n)
            node = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        last = node - inner
        g, h = np.bincount(last, grad, inner + 1), np.bincount(last, curve, inner + 1)
        leaf[t] = -rate * g / (h + damping)
        total += leaf[t][last]
    return Trees(start, feature, threshold, leaf)
