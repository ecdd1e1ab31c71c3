"""Gradient-boosted trees on a small table of integer features, scored as SQL.

Fitting runs on the driver over a bounded, weighted training table (equal rows
are merged before they are collected); scoring is a Catalyst expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: int  # goes left if the feature is at most this
    left: "Split | Leaf"
    right: "Split | Leaf"


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, rate: float, ridge: float) -> Split | Leaf:
    """One regression tree on gradients; the split with the largest gain, the first of equals."""
    g, h = grad.sum(), hess.sum()
    leaf = Leaf(float(-rate * g / (h + ridge)))
    if depth == 0:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        top = int(x[:, f].max())
        gs, hs = np.bincount(x[:, f], grad, top + 1).cumsum(), np.bincount(x[:, f], hess, top + 1).cumsum()
        gain = gs ** 2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g ** 2 / (h + ridge)
        at = int(gain[:-1].argmax()) if top else 0
        if top and gain[at] > best[0]:
            best = (gain[at], f, at)
    if best[1] is None:
        return leaf
    go = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[go], grad[go], hess[go], depth - 1, rate, ridge),
                 _grow(x[~go], grad[~go], hess[~go], depth - 1, rate, ridge))


def tree_values(tree: Split | Leaf, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, tree_values(tree.left, x), tree_values(tree.right, x))


def tree_sql(tree: Split | Leaf, names: Sequence[str]) -> str:
    if isinstance(tree, Leaf):
        return f"{tree.value!r}D"
    return (f"IF({names[tree.feature]} <= {tree.at}, {tree_sql(tree.left, names)}, {tree_sql(tree.right, names)})")


@dataclass(frozen=True)
class Boosted:
    """Trees, and the scale and shift that turn their sum into a calibrated log-odds."""

    trees: tuple
    prior: float
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((tree_values(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(x) + self.shift)))

    def probability_sql(self, names: Sequence[str]) -> str:
        total = " + ".join([f"{self.prior!r}D", *(tree_sql(t, names) for t in self.trees)])
        return f"(1D / (1D + exp(-({self.scale!r}D * ({total}) + {self.shift!r}D))))"


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3,
        ridge: float = 1.0) -> Boosted:
    """Logistic boosting of ``y`` (0 or 1) on non-negative integer features."""
    p = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    prior = float(np.log(p / (1 - p)))
    score, grown = np.full(len(x), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, weight * (p - y), weight * p * (1 - p), depth, rate, ridge)
        score = score + tree_values(tree, x)
        grown.append(tree)
    return Boosted(tuple(grown), prior)


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> Boosted:
    """Platt scaling of the raw scores on rows that were not fitted."""
    if not len(x) or not 0 < (y * weight).sum() < weight.sum():
        return model
    raw, a, b = model.raw(x), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        r, v = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(r * raw).sum() + ridge * (a - 1), r.sum() + ridge * b])
        hess = np.array([[(v * raw * raw).sum() + ridge, (v * raw).sum()], [(v * raw).sum(), v.sum() + ridge]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Boosted(model.trees, model.prior, float(a), float(b)) if a > 0 else model


def threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The lowest cut at which held-out precision reaches ``precision`` (0.5 at least; 1.01, so never, if none does)."""
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    ends = np.flatnonzero(np.append(p[1:] != p[:-1], True)) if len(p) else np.zeros(0, int)
    right = (y * weight).cumsum()[ends] / weight.cumsum()[ends]
    good = p[ends][right >= precision]
    return max(0.5, float(good.min()) - 1e-9) if len(good) else 1.01
