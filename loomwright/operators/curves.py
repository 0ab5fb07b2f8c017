"""Regression on saturating and log-normal response curves."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import mathops
from loomwright.operators.models import Regressor, solve
from loomwright.plans.columns import filled, with_all
from loomwright.plans.moments import Moments, moments, partial_sums
from loomwright.session import stored

# Where the curve parameters are searched, and the grid step.
GAMMA_RANGE, RHO_RANGE = (0.1, 3.0), (0.1, 2.0)
SIGMA_RANGE, MU_RANGE = (0.1, 3.0), (0.1, 2.0)
STEP = 0.1
# rows of a matrix with a column per candidate
BLOCK_ROWS = 2_048


def grid(low: float, high: float, step: float = STEP) -> list[float]:
    return [round(float(v), 4) for v in np.arange(low, high + step / 2, step)]


@dataclass(frozen=True)
class Counted:
    """Rows that agree in all features, counted once: a stored table and what is known of the targets as a whole.

    The table has one array per combination: rows, sums of the shifted targets, features.
    """

    table: DataFrame
    rows: float
    shift: list[float]
    squares: list[float]
    entropy: list[float]


@dataclass(frozen=True)
class CurveRegressor(Regressor):
    """Linear or Poisson regression on curve-transformed features, curve parameters by search.

    Candidates are tried together and each is judged by the model it stands for. Linear: one aggregate pass gives the
    covariances of all candidate curves of a feature with the target, and R2 follows from them. ``poisson`` (log link,
    ``alpha`` as in ``alpha / 2 * |weights|^2`` beside the mean likelihood): the Newton fits of all candidates advance
    together, one set of sums per step, and the explained share of the deviance decides. Features are searched in turn,
    the others held at their best so far.
    """

    candidates: tuple[tuple[float, float], ...] = ()
    rounds: int = 1
    poisson: bool = False
    alpha: float = 0.0
    steps: int = 60
    chosen: Mapping[str, tuple[float, float]] | None = None
    lowest: Mapping[str, float] | None = None
    linear: Mapping[str, tuple[list[float], float]] | None = None
    poisson_weights: Mapping[str, tuple[list[float], float]] | None = None
    search_scores: Mapping[str, float] | None = None

    def curve(self, x: Column, feature: str, pair: tuple[float, float]) -> Column:
        raise NotImplementedError

    def curves(self, df: DataFrame) -> DataFrame:
        return with_all(df, {f"_c_{c}": self.curve(filled(df, c), c, self.chosen[c]) for c in self.features})

    def start(self, df: DataFrame) -> CurveRegressor:
        middle = self.candidates[len(self.candidates) // 2]
        return replace(self, chosen={c: middle for c in self.features})

    def fit(self, df: DataFrame) -> CurveRegressor:
        ready = self.ready(df)
        model = self.start(ready)
        counted = model.counted(ready)
        scores: dict[str, float] = {}
        for _ in range(self.rounds):
            for c in self.features:
                model, scores[c] = model.search_one(counted, c)
        if self.poisson:
            # the fits of the last feature's winner are those of the whole model
            last = self.features[-1]
            fits = model.poisson_fits(counted, last, [model.chosen[last]])
            order = [last, *self.features[:-1]]
            weights = {t: ([float(w[0][1 + order.index(c)]) for c in self.features], float(w[0][0])) for t, (w, _) in zip(self.targets, fits)}
            return replace(model, poisson_weights=weights, search_scores=scores)
        names = [f"_c_{c}" for c in self.features]
        found = moments(model.curves(ready), [*names, *self.targets])
        fitted = {t: solve(found, names, t) for t in self.targets}
        return replace(
            model, linear={t: ([float(w) for w in s[0]], s[1]) for t, s in fitted.items()}, search_scores=scores
        )

    def counted(self, df: DataFrame) -> Counted:
        targets = [filled(df, t) for t in self.targets]
        facts = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(f"m{i}") for i, t in enumerate(targets)],
            *[F.var_pop(t).alias(f"v{i}") for i, t in enumerate(targets)], *[F.min(t).alias(f"lo{i}") for i, t in enumerate(targets)],
            *[F.sum(F.when(t > 0, t * F.log(t))).alias(f"e{i}") for i, t in enumerate(targets)],
        ).first()
        if not facts["n"]:
            raise ValueError("no rows to fit on")
        at = range(len(targets))
        if self.poisson and any(facts[f"lo{i}"] < 0 for i in at):
            raise ValueError("a Poisson model needs targets of 0 and above")
        shift = [0.0 if self.poisson else float(facts[f"m{i}"] or 0.0) for i in at]
        plain = df.select(*[filled(df, c).alias(f"x{i}") for i, c in enumerate(self.features)],
                          *[(t - F.lit(s)).alias(f"t{i}") for i, (t, s) in enumerate(zip(targets, shift))])
        keys = [f"x{i}" for i in range(len(self.features))]
        combos = plain.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"t{i}").alias(f"t{i}") for i in at])
        table = stored(combos.select(F.array("n", *[f"t{i}" for i in at], *keys).alias("_x")), "curve-inputs")
        return Counted(table, float(facts["n"]), shift, [float(facts[f"v{i}"]) for i in at], [float(facts[f"e{i}"] or 0.0) for i in at])

    def search_one(self, counted: Counted, feature: str) -> tuple[CurveRegressor, float]:
        """Best candidate of one feature; the mean score over the targets decides, first wins on a tie."""
        if self.poisson:
            scores = np.mean([score for _, score in self.poisson_fits(counted, feature, list(self.candidates))], axis=0)
        else:
            scores = [np.mean([solve(one, one.names[:len(self.features)], t)[2] for t in self.targets])
                      for one in self.candidate_moments(counted, feature)]
        best: tuple[float, tuple[float, float]] | None = None
        for pair, score in zip(self.candidates, scores):
            if best is None or score > best[0] + 1e-12:
                best = (float(score), pair)
        return replace(self, chosen={**self.chosen, feature: best[1]}), best[0]

    def tried_and_fixed(self, feature: str, pairs):
        """``matrix -> (count, target sums, a column per candidate, the curves of the other features)`` by rows of a block."""
        others = [c for c in self.features if c != feature]
        own, rest = self.features.index(feature), [self.features.index(c) for c in others]
        chosen, curve_matrix, first = self.chosen, self.matrix_function(), 1 + len(self.targets)

        def parts(x: np.ndarray):
            for low in range(0, len(x), BLOCK_ROWS):
                block = x[low:low + BLOCK_ROWS]
                tried = curve_matrix(block[:, first + own], feature, pairs)
                fixed = [curve_matrix(block[:, first + i], c, [chosen[c]])[:, 0] for i, c in zip(rest, others)]
                yield block[:, 0], block[:, 1:first], tried, np.column_stack(fixed) if fixed else np.zeros((len(block), 0))

        return parts, others

    def candidate_moments(self, counted: Counted, feature: str) -> list[Moments]:
        """Moments of (candidate curve, curves of the other features, targets) for every candidate.

        One pass: each task turns its batches into a matrix with a column per candidate and hands back
        sums only.
        """
        pairs, width = list(self.candidates), 1 + len(self.targets) + len(self.features)
        parts, others = self.tried_and_fixed(feature, pairs)
        count, held, targets = len(pairs), len(others), len(self.targets)
        shapes = [(count,), (count,), (held,), (targets,), (count, held), (count, targets), (held, held), (held, targets)]
        sizes = [int(np.prod(s)) for s in shapes]

        def sums(x: np.ndarray) -> np.ndarray:
            out = np.zeros(sum(sizes))
            for n, y, tried, fixed in parts(x):
                weighted = fixed * n[:, None]
                out += np.concatenate([v.ravel() for v in (
                    n @ tried, n @ tried**2, n @ fixed, y.sum(0), tried.T @ weighted, tried.T @ y, fixed.T @ weighted, fixed.T @ y)])
            return out

        acc = np.split(partial_sums(counted.table, "_x", width, sums, sum(sizes)) / counted.rows, np.cumsum(sizes)[:-1])
        one, two, three, four, by_fixed, by_target, among, crossed = (v.reshape(s) for v, s in zip(acc, shapes))
        between = np.hstack([by_fixed - np.outer(one, three), by_target - np.outer(one, four)])
        rest = np.block([[among - np.outer(three, three), crossed - np.outer(three, four)],
                         [(crossed - np.outer(three, four)).T, np.diag(counted.squares)]])
        names = ("_candidate", *[f"_c_{c}" for c in others], *self.targets)
        centre = np.concatenate([three, four + np.array(counted.shift)])
        return [
            Moments(names, int(counted.rows), np.concatenate([[one[i]], centre]),
                    np.block([[np.array([[two[i] - one[i] ** 2]]), between[i][None]], [between[i][:, None], rest]]))
            for i in range(count)
        ]

    def poisson_fits(self, counted: Counted, feature: str, pairs) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per target: weights (intercept, candidate curve, other curves) and explained deviance of every candidate.

        Newton steps of all candidates that still move are taken from one pass; a step that makes a fit worse is halved.
        """
        return [self._poisson_fit(counted, feature, pairs, k) for k in range(len(self.targets))]

    def _poisson_fit(self, counted: Counted, feature: str, pairs, target: int) -> tuple[np.ndarray, np.ndarray]:
        size, width = 1 + len(self.features), 1 + len(self.targets) + len(self.features)
        totals = partial_sums(counted.table, "_x", width, lambda x: x[:, 1 + target].sum(keepdims=True), 1)
        level = max(float(totals[0]) / counted.rows, 1e-12)
        weights = np.zeros((len(pairs), size))
        weights[:, 0] = np.log(level)
        penalty = self.alpha * np.r_[0.0, np.ones(size - 1)]
        value = np.full(len(pairs), -np.inf)  # penalised mean likelihood at ``weights``
        step, held = np.zeros_like(weights), weights.copy()
        moving = np.arange(len(pairs))
        for _ in range(self.steps):
            parts, _ = self.tried_and_fixed(feature, [pairs[k] for k in moving])
            gradient, curvature, reached = self._poisson_sums(counted, parts, weights[moving], target, width)
            w = weights[moving]
            reached = reached / counted.rows - 0.5 * (penalty * w * w).sum(1)
            worse = reached < value[moving] - 1e-12
            # back half of the way where the fit got worse or has no value
            back = worse | ~np.isfinite(reached)
            step[moving[back]] /= 2
            weights[moving[back]] = held[moving[back]] + step[moving[back]]
            good = moving[~back]
            gained = reached[~back] - value[good]
            value[good], held[good] = reached[~back], weights[good]
            g = gradient[~back] / counted.rows - penalty * weights[good]
            h = curvature[~back] / counted.rows + np.diag(penalty)
            h = h + 1e-12 * np.trace(h, axis1=1, axis2=2)[:, None, None] * np.eye(size)
            step[good] = np.linalg.solve(h, g[:, :, None])[:, :, 0]
            weights[good] = held[good] + step[good]
            done = gained < 1e-13 * (1 + np.abs(value[good]))
            weights[good[done]] = held[good[done]]
            # a step halved to nothing has ended too
            small = np.abs(step[moving[back]]).max(1, initial=0.0) < 1e-12
            moving = np.sort(np.concatenate([good[~done], moving[back][~small]]))
            if not len(moving):
                break
        likelihood = value + 0.5 * (penalty * held * held).sum(1)
        whole = counted.entropy[target] / counted.rows - level  # mean likelihood of a model that meets every row
        least = level * np.log(level) - level
        share = (likelihood - least) / (whole - least) if whole > least else np.zeros(len(pairs))
        return held, share

    @staticmethod
    def _poisson_sums(counted: Counted, parts, weights: np.ndarray, target: int, width: int):
        """Gradient, negative curvature and likelihood of every candidate at its weights."""
        count, size = weights.shape

        def sums(x: np.ndarray) -> np.ndarray:
            gradient, curvature, value = np.zeros((size, count)), np.zeros((size, size, count)), np.zeros(count)
            for n, y, tried, fixed in parts(x):
                line = weights[:, 0] + tried * weights[:, 1] + fixed @ weights[:, 2:].T
                with np.errstate(over="ignore", invalid="ignore"):
                    mean = n[:, None] * np.exp(line)
                    away = y[:, target][:, None] - mean
                    value += (y[:, target][:, None] * line - mean).sum(0)
                    inputs = [None, tried, *[fixed[:, k][:, None] for k in range(fixed.shape[1])]]
                    for i, a in enumerate(inputs):
                        gradient[i] += (away if a is None else away * a).sum(0)
                        own = mean if a is None else mean * a
                        for j, b in enumerate(inputs[i:], i):
                            curvature[i, j] += (own if b is None else own * b).sum(0)
            return np.concatenate([gradient.ravel(), curvature.ravel(), value])

        acc = partial_sums(counted.table, "_x", width, sums, count * (size + size * size + 1))
        gradient, curvature, value = np.split(acc, [size * count, (size + size * size) * count])
        gradient, curvature = gradient.reshape(size, count).T, np.moveaxis(curvature.reshape(size, size, count), 2, 0)
        upper = np.triu(curvature)
        return gradient, upper + np.triu(curvature, 1).transpose(0, 2, 1), value

    def matrix_function(self):
        """``(values, feature, pairs) -> matrix`` with one curve per column, for use inside tasks."""
        raise NotImplementedError

    def predictions(self, df: DataFrame) -> dict[str, Column]:
        fitted = self.linear if self.poisson_weights is None else self.poisson_weights
        if fitted is None:
            raise ValueError("fit first")
        lines = {
            t: reduce(operator.add, [
                F.lit(w) * self.curve(filled(df, c), c, self.chosen[c]) for w, c in zip(weights, self.features)
            ], F.lit(intercept))
            for t, (weights, intercept) in fitted.items()
        }
        return lines if self.poisson_weights is None else {t: F.exp(line) for t, line in lines.items()}


@dataclass(frozen=True)
class AdbudgRegressor(CurveRegressor):
    candidates: tuple[tuple[float, float], ...] = tuple(product(grid(*GAMMA_RANGE), grid(*RHO_RANGE)))
    magnitude: bool = False

    def curve(self, x: Column, feature: str, pair: tuple[float, float]) -> Column:
        return mathops.adbudg(x, pair[0], pair[1], self.magnitude)

    def matrix_function(self):
        magnitude = self.magnitude

        def curves(x: np.ndarray, feature: str, pairs) -> np.ndarray:
            gamma, rho = np.array(pairs).T
            powers, own = np.unique(gamma, return_inverse=True)  # few exponents for many pairs
            sign = np.sign(x)[:, None]
            top = np.abs(x)[:, None] ** powers
            if not magnitude:
                top = sign * top
            top = top[:, own]
            base = top + rho
            out = np.divide(top, base, out=np.full(base.shape, mathops.CURVE_GAP), where=base != 0)
            return sign * out if magnitude else out

        return curves


@dataclass(frozen=True)
class LogNormalRegressor(CurveRegressor):
    candidates: tuple[tuple[float, float], ...] = tuple(product(grid(*SIGMA_RANGE), grid(*MU_RANGE)))

    def start(self, df: DataFrame) -> LogNormalRegressor:
        row = df.agg(*[F.min(filled(df, c)).alias(f"lo{i}") for i, c in enumerate(self.features)]).first()
        return replace(super().start(df), lowest={c: float(v) for c, v in zip(self.features, row)})

    def curve(self, x: Column, feature: str, pair: tuple[float, float]) -> Column:
        return mathops.lognormal(x, pair[0], pair[1], self.lowest[feature])

    def matrix_function(self):
        lowest = dict(self.lowest)

        def curves(x: np.ndarray, feature: str, pairs) -> np.ndarray:
            sigma, mu = np.array(pairs).T
            moved = (x + lowest[feature] + mathops.CURVE_GAP)[:, None]
            logs = np.log(moved, out=np.zeros_like(moved), where=moved > 0)
            density = np.exp(-((logs - mu) ** 2) / (2 * sigma**2)) / (
                np.where(moved > 0, moved, 1.0) * np.sqrt(2 * np.pi) * sigma)
            return np.where(moved > 0, density, mathops.CURVE_GAP)

        return curves

