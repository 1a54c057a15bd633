"""Fitting of a sparse rule ensemble: tree paths, then lasso weights.

Runs on the driver over a bounded sample of numeric rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Boosted trees, their depth, the step of each and the smallest leaf.
TREES, DEPTH, STEP, LEAF = 24, 3, 0.4, 20

#: Thresholds per statistic, taken at quantiles of the sample.
BINS = 48

#: L1 penalty per row, and the rounds of the proximal gradient.
PENALTY, ROUNDS = 0.0015, 400

#: A condition ``statistic > threshold`` (True) or ``<= threshold`` (False).
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions, at most one of each direction per statistic."""

    conditions: tuple[Condition, ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for feature, above, threshold in self.conditions:
            out &= (x[:, feature] > threshold) == above
        return out


@dataclass(frozen=True)
class Ensemble:
    """``sigmoid(intercept + sum of the weights of the rules that hold)``."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def _simplify(path: list[Condition]) -> Rule:
    """The tightest threshold of each statistic and direction."""
    tight: dict[tuple[int, bool], float] = {}
    for feature, above, threshold in path:
        old = tight.get((feature, above), threshold)
        tight[feature, above] = max(old, threshold) if above else min(old, threshold)
    return Rule(tuple(sorted((f, a, t) for (f, a), t in tight.items())))


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths to all nodes of boosted trees, each rule once."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # Bin b holds the values over cut b - 1 and up to cut b.
    binned = [np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]
    rules: dict[Rule, None] = {}
    z = np.zeros(len(y))

    def grow(rows: np.ndarray, path: list[Condition], gradient: np.ndarray, curve: np.ndarray) -> None:
        g, h = gradient[rows], curve[rows]
        best, split = 1e-6, None
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b, size = binned[f][rows], len(c) + 1
                gl, hl, nl = (
                    np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g, h, np.ones(len(rows)))
                )
                gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
                at = int(gain.argmax())
                if gain[at] > best:
                    best, split = gain[at], (f, at)
        if split is None:
            z[rows] -= STEP * g.sum() / (h.sum() + 1)
            return
        f, at = split
        below = binned[f][rows] <= at
        for above, part in ((False, rows[below]), (True, rows[~below])):
            longer = [*path, (f, above, float(cuts[f][at]))]
            rules.setdefault(_simplify(longer))
            grow(part, longer, gradient, curve)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grow(np.arange(len(y)), [], p - y, np.maximum(p * (1 - p), 1e-6))
    return list(rules)


def lasso_logistic(columns: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights by accelerated proximal gradient."""
    mean, scale = columns.mean(axis=0), np.maximum(columns.std(axis=0), 1e-9)
    a = (columns - mean) / scale
    rate = 4 / max(1e-9, np.linalg.norm(a.T @ a / len(y), 2) + 1)
    w, b = np.zeros(a.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    look_w, look_b, pace = w, b, 1.0
    for _ in range(ROUNDS):
        residual = 1 / (1 + np.exp(-(a @ look_w + look_b))) - y
        moved = look_w - rate * (a.T @ residual) / len(y)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - rate * PENALTY, 0)
        new_b = look_b - rate * residual.mean()
        new_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        drift = (pace - 1) / new_pace
        look_w, look_b = new_w + drift * (new_w - w), new_b + drift * (new_b - b)
        w, b, pace = new_w, new_b, new_pace
    return b - float((w * mean / scale).sum()), w / scale


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """An ensemble for labels 0 and 1.

    Without both labels it is the smoothed share of label 1 for every row.
    """
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))))
    columns = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)
    intercept, weights = lasso_logistic(columns, y.astype(np.float64))
    kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9]
    return Ensemble(intercept, tuple(kept))
