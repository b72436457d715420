"""Histogram gradient-boosted trees for binary labels, in numpy.

A model is fitted on the driver from a bounded sample of numeric rows and applied inside Spark tasks.  Trees are
complete binary trees flattened into arrays, so applying one is ``depth`` vectorised gathers over a whole batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """``feature`` and ``threshold`` are (trees, inner nodes), ``leaf`` is (trees, 2**depth); node i has 2i+1, 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of leaves for each row of ``x``."""
        out = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0
) -> Forest:
    """Newton boosting of the log loss over quantile histograms.

    No rows gives a score of 0 everywhere, one class only gives nearly that class everywhere.
    """
    inner = 2**depth - 1
    if not len(x):
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), -30.0)
    rate0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(rate0 / (1 - rate0)))
    if y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    most = np.array([len(e) for e in edges])  # bin b holds edge[b-1] < value <= edge[b]
    flat = binned + np.arange(width) * bins
    rows, margin = np.arange(n), np.full(n, bias)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            size = count * width * bins
            gs = np.bincount(at, np.repeat(g, width), size).reshape(count, width, bins).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, width), size).reshape(count, width, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = -np.inf
            gain[:, np.arange(bins)[None, :] >= most[:, None]] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k], cut[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
        leaf_g = np.bincount(node - inner, g, inner + 1)
        leaf_h = np.bincount(node - inner, h, inner + 1)
        leaf = -rate * leaf_g / (leaf_h + l2)
        margin = margin + leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), bias)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots to be used with ``np.interp``.  One weak count of each class smooths the ends."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    values, at = np.unique(score, return_inverse=True)
    weight = np.bincount(at).astype(float)
    total = np.bincount(at, y.astype(float))
    pools: list[list[float]] = []
    for v, w, t in zip(values, weight, total, strict=True):
        pools.append([v, v, w, t])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    xs = np.array([x for p in pools for x in p[:2]])
    ys = np.array([(p[3] + 0.05) / (p[2] + 0.1) for p in pools for _ in range(2)])
    return xs, np.maximum.accumulate(ys)
