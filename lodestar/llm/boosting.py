"""Gradient-boosted trees of fixed depth for a bounded sample of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Sum of trees; a tree of depth d is d levels of (feature, cut) per node and 2**d leaf values."""

    depth: int = 3
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def _leaf(self, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.features[tree][at]] > self.cuts[tree][at])
        return at - (2**self.depth - 1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree, values in enumerate(self.leaves):
            score += values[self._leaf(x, tree)]
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 32) -> "Trees":
        """Logistic loss, second-order gains, cuts at quantiles of each feature."""
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        out = cls(depth, float(np.log(share / (1 - share))))
        if not len(y):
            return out
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), out.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            slope, curve = p - y, p * (1 - p)
            features, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                for at in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == at)
                    best = 1e-6
                    for f, e in enumerate(edges):
                        if not len(rows) or not len(e):
                            continue
                        g = np.bincount(binned[rows, f], slope[rows], len(e) + 1).cumsum()
                        h = np.bincount(binned[rows, f], curve[rows], len(e) + 1).cumsum()
                        gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, features[at], cuts[at] = gain[k], f, e[k]
                here = (node >= 2**level - 1) & (node < 2 ** (level + 1) - 1)
                node[here] = 2 * node[here] + 1 + (x[here, features[node[here]]] > cuts[node[here]])
            leaf = node - (2**depth - 1)
            g, h = np.bincount(leaf, slope, 2**depth), np.bincount(leaf, curve, 2**depth)
            values = -rate * g / (h + ridge)
            out.features.append(features)
            out.cuts.append(cuts)
            out.leaves.append(values)
            score += values[leaf]
        return out
