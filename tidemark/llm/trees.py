"""Gradient-boosted trees in numpy: logistic loss, features cut into quantile bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Boosted:
    """Trees of one depth: feature and bound of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray  # trees x (2^depth - 1)
    bound: np.ndarray
    leaf: np.ndarray  # trees x 2^depth

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            out += leaf[at - len(feature)]
        return out

    @classmethod
    def fit(
        cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 2.0
    ) -> "Boosted":
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(share / (1 - share))), *(np.zeros((trees, n), t) for n, t in
                    ((2**depth - 1, np.int64), (2**depth - 1, np.float64), (2**depth, np.float64))))
        logit = np.full(len(x), model.start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-logit))
            g, h = weight * (y - p), weight * p * (1 - p)
            at = np.zeros(len(x), np.int64)
            for level in range(depth):
                n, base = 2**level, 2**level - 1
                best = np.full(n, 1e-9)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    cell = (at - base) * (BINS + 1) + binned[:, f]
                    gs, hs = (np.bincount(cell, v, n * (BINS + 1)).reshape(n, -1).cumsum(1) for v in (g, h))
                    gl, hl, ga, ha = gs[:, : len(c)], hs[:, : len(c)], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best
                    best[better] = top[better]
                    model.feature[t, base : base + n][better] = f
                    model.bound[t, base : base + n][better] = c[k][better]
                at = 2 * at + 1 + (x[np.arange(len(x)), model.feature[t, at]] > model.bound[t, at])
            at -= 2**depth - 1
            gs, hs = np.bincount(at, g, 2**depth), np.bincount(at, h, 2**depth)
            model.leaf[t] = rate * gs / (hs + ridge)
            logit += model.leaf[t, at]
        return model
