"""Small gradient-boosted trees for a binary target, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    cuts: list[np.ndarray]
    #: per tree: feature, bin and value by heap position (children of k: 2k+1, 2k+2); feature -1 marks a leaf
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.full(len(x), self.base)
        for f, s, v in zip(self.feature, self.split, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                right = bins[np.arange(len(x)), np.maximum(f[at], 0)] > s[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            out += v[at]
        return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if len(x) else np.zeros((0, len(cuts)), np.int64)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the log loss; splits by gain over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]
    b = binned(x, cuts)
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    margin, size = np.full(len(x), base), 2 ** (depth + 1) - 1
    feature, split, value = (np.full((rounds, size), k, t) for k, t in ((-1, np.int64), (0, np.int64), (0.0, np.float64)))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            g, h = grad[rows].sum(), hess[rows].sum()
            value[r, node] = -rate * g / (h + ridge)
            if node >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts):
                gl = np.cumsum(np.bincount(b[rows, j], grad[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], hess[rows], len(c) + 1))[:-1]
                gain = np.where((hl >= least) & (h - hl >= least), gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), j, int(gain.argmax()))
            if best[1] >= 0:
                feature[r, node], split[r, node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        margin += value[r, at]
    return Trees(base, cuts, feature, split, value)
