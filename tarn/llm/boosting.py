"""Histogram gradient-boosted trees on numpy arrays, flattened for vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Complete binary trees of one depth: a feature and threshold per inner node, a value per leaf.

    Node i of a tree has children 2i + 1 and 2i + 2.  A node that was not split has the
    threshold infinity, so that every row goes left.
    """

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all trees step down one level at a time, for all rows at once."""
        trees, inner = self.features.shape
        if not trees or not len(x):
            return np.full(len(x), self.base)
        offset = np.arange(trees) * inner
        features, thresholds = self.features.ravel(), self.thresholds.ravel()
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        while node[0, 0] < inner:
            at = node + offset
            node = 2 * node + 1 + (x[rows, features[at]] > thresholds[at])
        at = node - inner + np.arange(trees) * (inner + 1)
        return self.base + self.leaves.ravel()[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between distinct values, at most ``bins`` - 1 of them, at quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins)))
    return (values[:-1] + values[1:]) / 2


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    penalty: float = 1.0,
    least_weight: float = 2.0,
) -> FlatTrees:
    """Boost on the logistic loss.  No rows, or one class only, give a constant."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    inner = 2**depth - 1
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    features = np.zeros((trees, inner), dtype=np.int64)
    thresholds = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    edges = [bin_edges(c, bins) for c in x.T]
    binned = [np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)]
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width = 2**level
            best = np.full(width, 1e-6)
            choice = np.full((width, 2), -1)
            for f, own in enumerate(binned):
                cuts = len(edges[f])
                if not cuts:
                    continue
                slot = node * (cuts + 1) + own
                size = width * (cuts + 1)
                gs = np.bincount(slot, g, size).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(slot, h, size).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl = gs[:, :-1], hs[:, :-1]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least_weight) | (ht - hl < least_weight)] = -1
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                choice[better, 0], choice[better, 1] = f, cut[better]
            goes_right = np.zeros(len(y), dtype=np.int64)
            for n, (f, cut) in enumerate(choice):
                if f >= 0:
                    features[t, width - 1 + n], thresholds[t, width - 1 + n] = f, edges[f][cut]
                    here = node == n
                    goes_right[here] = binned[f][here] > cut
            node = 2 * node + goes_right
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaves[t] = -rate * gs / (hs + penalty)
        margin += leaves[t][node]
    return FlatTrees(features, thresholds, leaves, base)
