"""Gradient-boosted trees for a logistic loss, small enough to fit on the driver
from a bounded number of weighted rows, and to run as a plain SQL expression on the cluster."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    names: list[str]
    base: float
    trees: list[tuple]  # (feature, cut, left, right) or a leaf's value
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += _apply(tree, x)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -40, 40)))

    def sql(self) -> str:
        """The calibrated probability as an expression over the named feature columns."""
        total = " + ".join([repr(self.base), *(_text(t, self.names) for t in self.trees)])
        return f"1D / (1D + exp(-greatest(-40D, least(40D, {self.slope!r}D * ({total}) + ({self.offset!r}D)))))"


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, left, right = tree
    return np.where(x[:, feature] <= cut, _apply(left, x), _apply(right, x))


def _text(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    feature, cut, left, right = tree
    return f"CASE WHEN {names[feature]} <= {cut!r}D THEN {_text(left, names)} ELSE {_text(right, names)} END"


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, ridge: float, rate: float):
    value = float(rate * gradient.sum() / (hessian.sum() + ridge))
    if depth == 0 or len(x) < 2:
        return value
    best, base = (1e-6, None, None), gradient.sum() ** 2 / (hessian.sum() + ridge)
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        v, g, h = x[order, feature], np.cumsum(gradient[order]), np.cumsum(hessian[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        gl, hl = g[ends], h[ends]
        gr, hr = g[-1] - gl, h[-1] - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - base
        gain[(hl < least) | (hr < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = float(gain[at]), feature, float(v[ends[at]])
    if best[1] is None:
        return value
    go = x[:, best[1]] <= best[2]
    left, right = (_grow(x[m], gradient[m], hessian[m], depth - 1, least, ridge, rate) for m in (go, ~go))
    return best[1], best[2], left, right


def fit(x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = 20, depth: int = 3, rate: float = 0.3, least: float = 1.0, ridge: float = 1.0, weight: np.ndarray | None = None, fold: np.ndarray | None = None) -> Trees:
    """Newton boosting on two of four rows; then a logistic curve over the margins of a third one
    calibrates them.  The last of each four is left to whoever chooses a threshold.

    weight: how many rows a row stands for; y is then the share of them that is positive.
    fold: which of the four a row is, from 0."""
    if not len(x):
        return Trees(names, 0.0, [], 0.0, -40.0)
    weight = np.ones(len(x)) if weight is None else weight
    share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    model = Trees(names, float(np.log(share / (1 - share))), [])
    place = np.arange(len(x)) % 4 if fold is None else fold
    seen, held = place < 2, place == 2
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x[seen], (weight * (y - p))[seen], (weight * p * (1 - p))[seen], depth, least, ridge, rate)
        model.trees.append(tree)
        margin += _apply(tree, x)
    model.slope, model.offset = _curve(margin[held], y[held], weight[held]) if held.any() else (1.0, 0.0)
    return model


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, towards 1 and 0 where there is little to learn from."""
    beta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    design = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2), design.T @ (weight * (y - p)) - (beta - start))
        beta = beta + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.05)), float(beta[1])


def threshold(probability: np.ndarray, y: np.ndarray, precision: float, weight: np.ndarray | None = None) -> float:
    """The smallest score at and above which that share of the rows is positive; above 1 if there is none."""
    order = np.argsort(-probability, kind="stable")
    weight = np.ones(len(y)) if weight is None else weight
    p, hits, rows = probability[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    ends = np.flatnonzero(np.r_[p[1:] < p[:-1], True]) if len(p) else np.zeros(0, int)
    good = ends[hits[ends] >= precision * rows[ends]]
    return float(p[good[-1]]) if len(good) else 2.0
