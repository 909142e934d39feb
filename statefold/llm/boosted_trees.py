"""Histogram gradient-boosted trees in numpy, flattened into arrays of complete binary trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature`` and ``cut``: (trees, 2**depth - 1) inner nodes in heap order; ``leaf``: (trees, 2**depth)."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].sum() < inner and len(at):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss. Without rows the forest is empty and its score 0.5; the base is the smoothed log-odds."""
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    inner, n, wide = 2**depth - 1, len(x), x.shape[1]
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(wide)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin > k  <=>  x > cuts[k]
    flat = binned + np.arange(wide) * bins
    raw, features, thresholds, leaves = np.full(n, base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at, feature, cut = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (wide * bins) + flat).ravel()
            gs, hs = (np.bincount(slot, np.repeat(v, wide), nodes * wide * bins).reshape(nodes, wide, bins).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = 0
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(nodes, -1).max(1) > 1e-6):
                j, b = divmod(int(best[k]), bins)
                feature[first + k], cut[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        cell = at - inner
        leaf = -rate * np.bincount(cell, g, inner + 1) / (np.bincount(cell, h, inner + 1) + ridge)
        raw += leaf[cell]
        features.append(feature), thresholds.append(cut), leaves.append(leaf)
    return Forest(base, np.stack(features), np.stack(thresholds), np.stack(leaves))
