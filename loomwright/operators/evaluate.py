"""Fitted models as functions of numpy columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np

from loomwright.operators import models
from loomwright.operators.curves import CurveRegressor

Columns = Mapping[str, np.ndarray]
#: columns by name (gaps already 0) -> predictions by target
Evaluator = Callable[[Columns], dict[str, np.ndarray]]


def stacked(columns: Columns, names: tuple[str, ...]) -> np.ndarray:
    """The named columns side by side; absent ones are 0."""
    rows = len(next(iter(columns.values())))
    return np.column_stack([columns[c] if c in columns else np.zeros(rows) for c in names]) if names else np.zeros((rows, 0))


@dataclass(frozen=True)
class Tree:
    """A regression tree as arrays: where a node goes on, or its value at a leaf (which goes on to itself)."""

    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.low[at], self.high[at])
        return self.value[at]

    @staticmethod
    def of(model) -> Tree | None:
        """The arrays of a Spark ML tree; None if it splits by categories."""
        rows: list[list] = []
        todo = [(model._call_java("rootNode"), None, 0)]
        while todo:
            node, side, parent = todo.pop()
            own = len(rows)
            rows.append([0, np.inf, own, own, float(node.prediction())])
            if side is not None:
                rows[parent][side] = own
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                if split.getClass().getSimpleName() != "ContinuousSplit":
                    return None
                rows[own][:2] = [int(split.featureIndex()), float(split.threshold())]
                todo += [(node.leftChild(), 2, own), (node.rightChild(), 3, own)]
        feature, limit, low, high, value = (np.array(c) for c in zip(*rows))
        return Tree(feature, limit, low, high, value, int(model.depth))


INVERSE_LINKS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda v: v, "log": np.exp, "inverse": lambda v: 1 / v, "sqrt": lambda v: v * v,
    "logit": lambda v: 1 / (1 + np.exp(-v)),
}


def matrix_function(model) -> Callable[[np.ndarray], np.ndarray] | None:
    """A fitted Spark ML regressor as ``matrix -> predictions``; None if its kind is not known here."""
    kind = type(model).__name__
    if kind == "DecisionTreeRegressionModel":
        return Tree.of(model)
    if kind in ("RandomForestRegressionModel", "GBTRegressionModel"):
        trees, weights = [Tree.of(t) for t in model.trees], np.array(model.treeWeights, float)
        if any(t is None for t in trees):
            return None
        whole = weights.sum() if kind.startswith("Random") else 1.0
        return lambda x: sum(w * t(x) for w, t in zip(weights, trees)) / whole
    if kind in ("LinearRegressionModel", "GeneralizedLinearRegressionModel"):
        weights, intercept = model.coefficients.toArray(), float(model.intercept)
        inverse = INVERSE_LINKS["identity"]
        if kind.startswith("General"):
            link = model.getOrDefault("link") if model.isDefined("link") else None
            link = link or {"gaussian": "identity", "poisson": "log", "gamma": "inverse", "binomial": "logit"}.get(model.getOrDefault("family"))
            if link not in INVERSE_LINKS:
                return None
            inverse = INVERSE_LINKS[link]
        return lambda x: inverse(x @ weights + intercept)
    return None


def evaluator(model: models.Regressor) -> Evaluator | None:
    """The function of a fitted model, or None for kinds that only work on tables."""
    if isinstance(model, models.LinearRegressor):
        features = model.features
        weights = {t: (np.array(model.weights[t], float), float(model.intercepts[t])) for t in model.targets}
        return lambda columns: {t: stacked(columns, features) @ w + b for t, (w, b) in weights.items()}
    if isinstance(model, models.SparkRegressor):
        features, functions = model.features, {t: matrix_function(m) for t, m in model.fitted.items()}
        if any(f is None for f in functions.values()):
            return None
        return lambda columns: {t: f(stacked(columns, features)) for t, f in functions.items()}
    if isinstance(model, models.StackedRegressor):
        bases, last = [evaluator(b) for b in model.bases], evaluator(model.meta)
        if any(b is None for b in bases):
            return None

        def both(columns: Columns) -> dict[str, np.ndarray]:
            first = {f"_base{k}_{t}": v for k, base in enumerate(bases) for t, v in base(columns).items()}
            return last({**columns, **first})

        return both
    if isinstance(model, models.DefaultedRegressor):
        base, defaults = evaluator(model.base), dict(model.defaults)
        if base is None:
            return None

        def defaulted(columns: Columns) -> dict[str, np.ndarray]:
            held = dict(columns)
            for part, value in defaults.items():
                held |= {c: np.full(len(v), float(value)) for c, v in held.items() if part in c}
            return base(held)

        return defaulted
    if isinstance(model, CurveRegressor):
        features, chosen, curve = model.features, dict(model.chosen), model.matrix_function()
        inverse = INVERSE_LINKS["identity" if model.poisson_weights is None else "log"]
        weights = {t: (np.array(w, float), float(b)) for t, (w, b) in (model.poisson_weights or model.linear).items()}

        def curved(columns: Columns) -> dict[str, np.ndarray]:
            x = stacked(columns, features)
            bent = np.column_stack([curve(x[:, i], c, [chosen[c]])[:, 0] for i, c in enumerate(features)])
            return {t: inverse(bent @ w + b) for t, (w, b) in weights.items()}

        return curved
    return None


def inputs(model: models.Regressor) -> tuple[str, ...]:
    """The columns that a model's evaluator reads."""
    if isinstance(model, models.StackedRegressor):
        return tuple(dict.fromkeys([*model.features, *(c for b in model.bases for c in inputs(b))]))
    if isinstance(model, models.DefaultedRegressor):
        return tuple(dict.fromkeys([*model.features, *inputs(model.base)]))
    return tuple(model.features)
