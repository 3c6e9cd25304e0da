"""Gradient-boosted regression trees over binned features, and the calibration of their scores to grades (numpy only)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    trees: int = 150
    depth: int = 4
    rate: float = 0.08
    bins: int = 48
    least_rows: int = 8
    penalty: float = 1.0


class Boosted:
    """A sum of regression trees with squared loss. Trees are complete binary trees in arrays; a split goes right above a bin."""

    def __init__(self, settings: Settings = Settings()):
        self.settings = settings
        self.edges: list[np.ndarray] = []
        self.base = 0.0
        self.features: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        s = self.settings
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(x.shape[1])] if len(x) else [np.empty(0)] * x.shape[1]
        self.base = float(y.mean()) if len(y) else 0.0
        binned = self._binned(x)
        rows, columns = x.shape
        flat = binned.astype(np.int64) + np.arange(columns) * s.bins
        score = np.full(rows, self.base)
        for _ in range(s.trees if rows >= 2 * s.least_rows else 0):
            residual = y - score
            nodes = np.zeros(rows, np.int64)
            feature, cut = np.full((1 << s.depth) - 1, -1), np.full((1 << s.depth) - 1, 255)
            for level in range(s.depth):
                width = 1 << level
                where = (nodes[:, None] * (columns * s.bins) + flat).ravel()
                size = width * columns * s.bins
                n = np.bincount(where, minlength=size).reshape(width, columns, s.bins).cumsum(axis=2)
                g = np.bincount(where, np.repeat(residual, columns), minlength=size).reshape(width, columns, s.bins).cumsum(axis=2)
                all_n, all_g = n[:, :1, -1:], g[:, :1, -1:]
                right_n, right_g = all_n - n, all_g - g
                gain = g**2 / (n + s.penalty) + right_g**2 / (right_n + s.penalty) - all_g**2 / (all_n + s.penalty)
                gain[(n < s.least_rows) | (right_n < s.least_rows)] = -np.inf
                best = gain.reshape(width, -1).argmax(axis=1)
                ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-12
                first = width - 1
                feature[first : first + width] = np.where(ok, best // s.bins, -1)
                cut[first : first + width] = np.where(ok, best % s.bins, 255)
                f, c = feature[first + nodes], cut[first + nodes]
                right = (f >= 0) & (binned[np.arange(rows), np.maximum(f, 0)] > c)
                nodes = nodes * 2 + right
            count = np.bincount(nodes, minlength=1 << s.depth)
            leaf = s.rate * np.bincount(nodes, residual, minlength=1 << s.depth) / (count + s.penalty)
            score += leaf[nodes]
            self.features.append(feature)
            self.cuts.append(cut)
            self.leaves.append(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        rows = np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            nodes = np.zeros(len(x), np.int64)
            for level in range(self.settings.depth):
                at = (1 << level) - 1 + nodes
                f = feature[at]
                nodes = nodes * 2 + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > cut[at]))
            score += leaf[nodes]
        return score


@dataclass
class Calibration:
    """Cut points between neighbouring grades, set on held-out scores."""

    grades: np.ndarray
    cuts: np.ndarray

    def grade(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[np.searchsorted(self.cuts, scores, side="right")]


def calibrate(scores: np.ndarray, grades: np.ndarray) -> Calibration:
    """Between two neighbouring grades the cut that puts the fewest held-out scores on the wrong side (the middle of the best stretch)."""
    levels = np.unique(grades)
    cuts = []
    for low, high in zip(levels[:-1], levels[1:]):
        order = np.argsort(scores, kind="stable")
        s, above = scores[order], (grades[order] >= high)
        # Errors when the cut lies before position k: grades above it that lie below the cut, and the other way round.
        wrong = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([[0], np.cumsum(~above[::-1])])[::-1]
        best = np.flatnonzero(wrong == wrong.min())
        k = int(best[len(best) // 2])
        left, right = s[max(k - 1, 0)], s[min(k, len(s) - 1)]
        cuts.append((left + right) / 2 if 0 < k < len(s) else (left - 1e-9 if k == 0 else right + 1e-9))
    return Calibration(levels, np.maximum.accumulate(np.array(cuts)))
