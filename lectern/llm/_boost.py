"""Gradient-boosted trees for a two-class target, on binned features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, trees of fixed depth stored as complete arrays, Newton leaf values."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x = np.asarray(x, np.float64)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(prior / (1 - prior)))
        score = np.full(len(y), self.base)
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(codes, y - p, p * (1 - p))
            self.model.append(tree)
            score += self._walk(tree, codes)
        return self

    def _grow(self, codes, grad, hess):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins + 1)
        leaf = np.zeros(2**self.depth)
        rows = {0: np.arange(len(grad))}
        for node in range(inner):
            own = rows.pop(node)
            best = 1e-9
            g_all, h_all = grad[own].sum(), hess[own].sum()
            for f in range(codes.shape[1]):
                c = codes[own, f]
                g = np.cumsum(np.bincount(c, grad[own], self.bins + 1))
                h = np.cumsum(np.bincount(c, hess[own], self.bins + 1))
                gain = g**2 / (h + self.ridge) + (g_all - g) ** 2 / (h_all - h + self.ridge) - g_all**2 / (h_all + self.ridge)
                k = int(gain[:-1].argmax())
                if gain[k] > best:
                    best, feature[node], cut[node] = gain[k], f, k
            right = codes[own, feature[node]] > cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
        for k in range(2**self.depth):
            own = rows[inner + k]
            leaf[k] = self.rate * grad[own].sum() / (hess[own].sum() + self.ridge)
        return feature, cut, leaf

    def _walk(self, tree, codes):
        feature, cut, leaf = tree
        node = np.zeros(len(codes), np.int64)
        at = np.arange(len(codes))
        for _ in range(self.depth):
            node = 2 * node + 1 + (codes[at, feature[node]] > cut[node])
        return leaf[node - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        codes = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        return self.base + sum((self._walk(t, codes) for t in self.model), np.zeros(len(x)))


def platt(score: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve from scores to probabilities, by Newton steps."""
    w = np.array([1.0, 0.0])
    x = np.stack([score, np.ones_like(score)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def least_threshold(prob: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability above which at least `precision` of the held-out cases are positive."""
    order = np.argsort(-prob, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[prob[order][1:] != prob[order][:-1], True]
    good = np.flatnonzero(last & (share >= precision))
    return float(prob[order][good[-1]]) if len(good) else 1.0
