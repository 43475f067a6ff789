"""Gradient-boosted trees for two classes on small dense tables: binned features, logistic loss, level-wise trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, BINS, RATE, PENALTY, LEAST = 60, 4, 32, 0.2, 1.0, 8


@dataclass
class Boosted:
    """``feature`` and ``limit`` of each inner node and ``value`` of each leaf, trees in rows, nodes in heap order."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > limit[at])
            out += value[at - inner]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    n, width = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    if not n:
        return Boosted(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(borders[f], x[:, f], "left") for f in range(width)])
    logit, trees = np.full(n, start), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, p * (1 - p)
        feature, limit, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            own = at - first
            best = np.full(nodes, 1e-9)
            total_g, total_h = np.bincount(own, grad, nodes), np.bincount(own, hess, nodes)
            for f in range(width):
                cells = len(borders[f]) + 1
                key = own * cells + binned[:, f]
                g, h, c = (np.bincount(key, w, nodes * cells).reshape(nodes, cells).cumsum(1)[:, :-1] for w in (grad, hess, None))
                if not g.shape[1]:
                    continue
                rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                gain = g**2 / (h + PENALTY) + rest_g**2 / (rest_h + PENALTY) - (total_g**2 / (total_h + PENALTY))[:, None]
                count = np.bincount(own, minlength=nodes)[:, None]
                gain[(c < LEAST) | (count - c < LEAST)] = -np.inf
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best
                best[better] = gain[np.arange(nodes), top][better]
                feature[first : first + nodes][better] = f
                limit[first : first + nodes][better] = borders[f][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > limit[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + PENALTY)
        logit = logit + value[leaf]
        trees.append((feature, limit, value))
    return Boosted(np.array([t[0] for t in trees]), np.array([t[1] for t in trees]), np.array([t[2] for t in trees]), start)
