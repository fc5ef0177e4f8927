"""Gradient-boosted trees for a yes/no label, small enough to be sent along with a task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth stored level by level: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.depth, self.start, self.feature, self.threshold, self.leaf = depth, start, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, bins: int = 32) -> Boosted:
    """Newton boosting on the logistic loss with splits at quantiles."""
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(y), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            inside = np.flatnonzero(at == node)
            best = _best_split(binned[inside], g[inside], h[inside], cuts, penalty) if len(inside) > 1 else None
            if best is not None:
                feature[node], threshold[node] = best[0], cuts[best[0]][best[1]]
            at[inside] = 2 * node + 1 + (x[inside, feature[node]] > threshold[node])
        for k in range(inner + 1):
            inside = at == inner + k
            leaf[k] = rate * g[inside].sum() / (h[inside].sum() + penalty)
        margin += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Boosted(depth, start, np.array(features), np.array(thresholds), np.array(leaves))


def _best_split(binned, g, h, cuts, penalty) -> tuple[int, int] | None:
    whole_g, whole_h = g.sum(), h.sum()
    best, found = whole_g**2 / (whole_h + penalty) + 1e-9, None
    for f, c in enumerate(cuts):
        if len(c):
            left_g = np.bincount(binned[:, f], g, len(c) + 1).cumsum()[:-1]
            left_h = np.bincount(binned[:, f], h, len(c) + 1).cumsum()[:-1]
            gain = left_g**2 / (left_h + penalty) + (whole_g - left_g) ** 2 / (whole_h - left_h + penalty)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (f, k)
    return found
