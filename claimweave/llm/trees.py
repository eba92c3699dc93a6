"""Histogram gradient-boosted trees for the driver: training on rows or on counted distinct rows, flat arrays, calibration.

A tree is four arrays: feature, threshold (go left if value <= threshold), left child (right is left + 1) and
value; a leaf has feature -1. All trees of a model share the arrays, with the roots' places beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that every row reaches, all rows and trees at once, plus the base."""
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(inner, self.left[node] + right, node)
        return self.base + self.value[node].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _edges(column: np.ndarray, bins: int, times: np.ndarray | None = None) -> np.ndarray:
    """Thresholds half-way between distinct values, at most bins - 1 of them; times: how often each value counts."""
    values = np.unique(column)
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) >= bins:
        share = np.linspace(0, 1, bins + 1)[1:-1]
        if times is None:
            return np.unique(np.quantile(column, share))
        order = np.argsort(column, kind="stable")
        reached = np.cumsum(times[order])
        middle = np.unique(column[order][np.searchsorted(reached, share * reached[-1])])
    return middle


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0, times: np.ndarray | None = None) -> Forest:
    """Boosted trees for the logistic loss; with one class or no rows the forest is its base alone. times: how often each row counts."""
    t = np.ones(len(y)) if times is None else times
    p = ((t * y).sum() + 1) / (t.sum() + 2)
    base = float(np.log(p / (1 - p)))
    arrays: list[list] = [[], [], [], []]
    roots = []
    if len(y) and 0 < y.sum() < len(y):
        n, m = x.shape
        edges = [_edges(x[:, j], bins, times) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        offset = np.arange(m) * bins
        raw = np.full(n, base)
        for _ in range(trees):
            s = 1 / (1 + np.exp(-raw))
            gradient, weight = t * (y - s), t * s * (1 - s)
            roots.append(len(arrays[0]))

            def add(rows: np.ndarray, g: float, h: float) -> int:
                for a, v in zip(arrays, (-1, 0.0, 0, rate * g / (h + ridge))):
                    a.append(v)
                return len(arrays[0]) - 1

            todo = [(add(np.arange(n), gradient.sum(), weight.sum()), np.arange(n), 0)]
            while todo:
                node, rows, level = todo.pop()
                done = level == depth or t[rows].sum() < 2 * least
                if not done:
                    flat = (binned[rows] + offset).ravel()
                    g, h, c = (np.bincount(flat, np.repeat(w, m), m * bins).reshape(m, bins).cumsum(1) for w in (gradient[rows], weight[rows], t[rows]))
                    gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                    gain[(c < least) | (c[:, -1:] - c < least)] = 0
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    done = gain[j, b] <= 1e-6 or b >= len(edges[j])
                if done:
                    raw[rows] += arrays[3][node]
                    continue
                goes = binned[rows, j] <= b
                left, right = rows[goes], rows[~goes]
                first = add(left, gradient[left].sum(), weight[left].sum())
                second = add(right, gradient[right].sum(), weight[right].sum())
                arrays[0][node], arrays[1][node], arrays[2][node] = int(j), float(edges[j][b]), first
                todo += [(first, left, level + 1), (second, right, level + 1)]
    kinds = (np.int64, np.float64, np.int64, np.float64)
    return Forest(*[np.array(a, k) for a, k in zip(arrays, kinds)], np.array(roots, np.int64), depth, base)


def as_sql(forest: Forest, names: list[str]) -> str:
    """The forest's raw score as a SQL expression over the named columns."""

    def node(i: int) -> str:
        f = int(forest.feature[i])
        if f < 0:
            return f"{forest.value[i]:.9e}D"
        return f"CASE WHEN {names[f]} <= {forest.threshold[i]:.9e}D THEN {node(int(forest.left[i]))} ELSE {node(int(forest.left[i]) + 1)} END"

    return " + ".join([f"{forest.base:.9e}D", *[f"({node(int(r))})" for r in forest.roots]])


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float, times: np.ndarray | None = None) -> float:
    """The lowest score from which on the share of ones is at least precision; 2 (never) if there is none."""
    if not len(score):
        return 2.0
    order = np.argsort(-score, kind="stable")
    t = np.ones(len(y)) if times is None else times[order]
    share = np.cumsum(t * y[order]) / np.cumsum(t)
    last = np.append(np.diff(score[order]) != 0, True)
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else 2.0
