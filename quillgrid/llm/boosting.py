"""Histogram gradient-boosted trees in numpy: fitted level by level on binned features, traversed as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth as (trees, nodes) arrays; node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    prior: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x; all trees of a row advance together, a level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        out = np.empty(len(x))
        for i in range(0, len(x), 4096):
            block = x[i : i + 4096]
            node = np.zeros((len(block), len(self.feature)), dtype=np.int64)
            rows = np.arange(len(block))[:, None]
            for _ in range(self.depth):
                node = 2 * node + 1 + (block[rows, self.feature[trees, node]] > self.threshold[trees, node])
            raw = self.prior + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
            out[i : i + 4096] = 1 / (1 + np.exp(-raw))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, least: float = 8.0, ridge: float = 1.0) -> Forest:
    """Log-loss boosting. ``least`` is the hessian mass a child needs, ``ridge`` the L2 penalty of a leaf."""
    n, k = x.shape if len(x) else (0, x.shape[1])
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, 2**depth))
    ones = float(np.sum(y)) if n else 0.0
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if n == 0 or ones in (0.0, float(n)):
        return Forest(feature, threshold, value, prior, depth)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(k)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(k)])
    raw = np.full(n, prior)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            slot = (node - base) * bins
            total_g, total_h = np.bincount(node - base, g, width), np.bincount(node - base, h, width)
            best = np.full(width, 1e-9)
            for f in range(k):
                if not len(edges[f]):
                    continue
                at = slot + binned[f]
                lg = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(edges[f])]
                lh = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, : len(edges[f])]
                rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(lh < least) | (rh < least)] = -1
                cut = gain.argmax(axis=1)
                got = gain[np.arange(width), cut]
                better = got > best
                best[better] = got[better]
                feature[t, base : base + width][better] = f
                threshold[t, base : base + width][better] = edges[f][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        raw += value[t][leaf]
    return Forest(feature, threshold, value, prior, depth)
