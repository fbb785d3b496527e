"""Histogram gradient-boosted trees with monotonic constraints, flattened into numpy arrays.

A model is fitted on the driver from a bounded sample of labelled rows and scored in tasks. Trees are complete and of one
depth, so a tree is three rows of arrays and scoring is D steps of array indexing for all trees and rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; rows above it go right
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        n_trees, n_inner = self.feature.shape
        out = np.full(len(x), self.base)
        if n_trees == 0 or len(x) == 0:
            return out
        rows, trees = np.arange(len(x))[:, None], np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), np.int64)
        while node[0, 0] < n_inner:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return out + self.value[trees, node - n_inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least_weight: float = 2.0) -> FlatTrees:
    """Boosting on log loss. monotone: -1, 0 or 1 for each feature, the direction in which the score may move with it.

    A constrained feature may split a node only if its children's values are in order, and each child is held on its side
    of the middle between them, so no descendant can undo the order. Without rows of both classes the model is a constant.
    """
    n_inner, n_leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return FlatTrees(np.zeros((0, n_inner), np.int64), np.zeros((0, n_inner)), np.zeros((0, n_leaves)), base)
    n_features = x.shape[1]
    monotone = np.zeros(n_features, int) if monotone is None else np.asarray(monotone)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])  # bin b: at most edge b

    margin = np.full(len(y), base)
    out_feature, out_threshold, out_value = np.zeros((trees, n_inner), np.int64), np.full((trees, n_inner), np.inf), np.zeros((trees, n_leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * n_inner + 1, -np.inf), np.full(2 * n_inner + 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            split = [None] * count
            for f in range(n_features):
                n_bins = len(edges[f]) + 1
                if n_bins < 2:
                    continue
                slot = (node - first) * n_bins + binned[:, f]
                g = np.bincount(slot, gradient, count * n_bins).reshape(count, n_bins).cumsum(1)
                h = np.bincount(slot, weight, count * n_bins).reshape(count, n_bins).cumsum(1)
                gl, hl, gs, hs = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gr, hr = gs - gl, hs - hl
                lo, hi = low[first : first + count, None], high[first : first + count, None]
                vl, vr = np.clip(gl / (hl + l2), lo, hi), np.clip(gr / (hr + l2), lo, hi)
                vs = np.clip(gs / (hs + l2), lo, hi)
                gain = 2 * (gl * vl + gr * vr - gs * vs) - (hl + l2) * vl**2 - (hr + l2) * vr**2 + (hs + l2) * vs**2
                gain[(hl < least_weight) | (hr < least_weight) | (monotone[f] * (vr - vl) < 0)] = -np.inf
                at = gain.argmax(1)
                top = gain[np.arange(count), at]
                for k in np.flatnonzero(top > best):
                    best[k], split[k] = top[k], (f, at[k], vl[k, at[k]], vr[k, at[k]])
            for k, s in enumerate(split):
                n = first + k
                low[[2 * n + 1, 2 * n + 2]], high[[2 * n + 1, 2 * n + 2]] = low[n], high[n]
                if s is not None:
                    f, b, vl, vr = s
                    out_feature[t, n], out_threshold[t, n] = f, edges[f][b]
                    if monotone[f]:
                        middle = (vl + vr) / 2
                        upper, lower = (2 * n + 2, 2 * n + 1) if monotone[f] > 0 else (2 * n + 1, 2 * n + 2)
                        low[upper], high[lower] = max(low[upper], middle), min(high[lower], middle)
            node = 2 * node + 1 + (x[np.arange(len(y)), out_feature[t, node]] > out_threshold[t, node])
        leaf = node - n_inner
        g, h = np.bincount(leaf, gradient, n_leaves), np.bincount(leaf, weight, n_leaves)
        out_value[t] = rate * np.clip(g / (h + l2), low[n_inner:], high[n_inner:])
        margin += out_value[t, leaf]
    return FlatTrees(out_feature, out_threshold, out_value, base)
