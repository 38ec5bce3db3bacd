"""Gradient boosted regression trees for log-loss, on histograms, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Newton boosting: leaves are -G / (H + l2), splits maximise the gain of G^2 / (H + l2)."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(share / (1 - share)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, edges, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += self._apply(tree, x)
        return self

    def _grow(self, binned, edges, g, h):
        """A full tree as arrays by heap place: column (-1: leaf), limit, value."""
        size = 2 ** (self.depth + 1) - 1
        column, limit, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(g), np.int64)
        for place in range(size):
            own = np.flatnonzero(node == place)
            if not len(own):
                continue
            total_g, total_h = g[own].sum(), h[own].sum()
            value[place] = -self.rate * total_g / (total_h + self.l2)
            if place >= 2**self.depth - 1 or len(own) < 2 * self.least:
                continue
            best, gain = None, 1e-6
            for c, e in enumerate(edges):
                if not len(e):
                    continue
                k = binned[own, c]
                left_g, left_h, n = (np.cumsum(np.bincount(k, w, len(e) + 1))[:-1] for w in (g[own], h[own], None))
                score = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
                score[(n < self.least) | (len(own) - n < self.least)] = -1
                if score.max() > gain:
                    gain, best = score.max(), (c, int(score.argmax()))
            if best is not None:
                column[place], limit[place] = best[0], edges[best[0]][best[1]]
                node[own] = 2 * place + 1 + (binned[own, best[0]] > best[1])
        return column, limit, value

    def _apply(self, tree, x):
        column, limit, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            inner = column[node] >= 0
            go = x[np.arange(len(x)), np.maximum(column[node], 0)] > limit[node]
            node = np.where(inner, 2 * node + 1 + go, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        for tree in self.trees:
            raw += self._apply(tree, x)
        return 1 / (1 + np.exp(-raw))
