"""Small gradient-boosted trees for bounded samples, with calibrated thresholds.

Newton boosting of logistic loss on binned columns; every tree is complete, so a batch is
scored with a few array look-ups per tree.
"""

from __future__ import annotations

import numpy as np


class Trees:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32,
                 l2: float = 2.0, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least
        self.start = -4.0
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale = np.array([0.0, 1.0])

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> "Trees":
        w = np.ones(len(y)) if w is None else w
        rate = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)])
        width, inner = self.bins, 2 ** self.depth - 1
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = w * (y - p), w * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            column, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(self.depth):
                first, many = 2 ** level - 1, 2 ** level
                best = np.zeros(many)
                pick = np.full(many, width)                     # a bin that sends all rows left
                for f in range(x.shape[1]):
                    at = (node - first) * width + code[:, f]
                    gs = np.bincount(at, g, many * width).reshape(many, width)
                    hs = np.bincount(at, h, many * width).reshape(many, width)
                    gl, hl = gs.cumsum(1), hs.cumsum(1)
                    ga, ha = gl[:, -1:], hl[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (ga - gl)**2 / (ha - hl + self.l2) - ga**2 / (ha + self.l2)
                    gain[(hl < self.least) | (ha - hl < self.least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(many), top] > best + 1e-9
                    best = np.where(better, gain[np.arange(many), top], best)
                    pick = np.where(better, top, pick)
                    column[first:first + many][better] = f
                for k in range(many):
                    e = edges[column[first + k]]
                    cut[first + k] = e[pick[k]] if pick[k] < len(e) else np.inf
                right = x[np.arange(len(y)), column[node]] > cut[node]
                node = 2 * node + 1 + right
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.l2)
            z += value[leaf]
            self.splits.append((column, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        row = np.arange(len(x))
        for column, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, column[node]] > cut[node])
            z += value[node - len(column)]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        """Fit the logistic scale of the margins on rows that the trees have not seen."""
        if not 0 < y.sum() < len(y):
            return self
        z = np.column_stack([np.ones(len(y)), self.margin(x)])
        beta = self.scale.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - p) - 0.1 * (beta - [0, 1]))
            beta += np.clip(step, -2, 2)
        self.scale = beta
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * self.margin(x), -30, 30)))


def threshold(p: np.ndarray, y: np.ndarray, precision: float, floor: float) -> float:
    """Half-way below the least probability from which on the share of ones reaches ``precision``.

    Never under ``floor``; 1.1 if no probability above ``floor`` reaches it.
    """
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    ends = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else np.zeros(0, int)
    good = [e for e in ends if p[e] >= floor and y[:e + 1].mean() >= precision]
    if not good:
        return 1.1
    below = p[good[-1] + 1] if good[-1] + 1 < len(p) else 0.0
    return max(floor, float(p[good[-1]] + below) / 2)
