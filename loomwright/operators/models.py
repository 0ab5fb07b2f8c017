"""Regressors: linear models from moments, per-group models, Spark ML regressors, stacking, factors."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import metrics
from loomwright.operators.select import SetByName
from loomwright.plans.columns import apart, filled, q, with_all
from loomwright.plans.joins import BROADCAST_ROWS, fits, salted_join
from loomwright.plans.moments import Moments, moments, moments_table, packed
from loomwright.plans.operator import Operator
from loomwright.session import cut_lineage


# features above which rows are scored outside whole-stage code, whose methods would be too long to be compiled
WIDE = 20


def prediction_name(target: str) -> str:
    return f"pred_{target}"


@dataclass(frozen=True)
class Regressor(Operator):
    """Features in, one ``pred_<target>`` column per target out; missing features count as 0."""

    features: tuple[str, ...]
    targets: tuple[str, ...]

    def predictions(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def ready(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: F.lit(0.0) for c in self.features if c not in df.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.ready(df)
        return with_all(ready, {prediction_name(t): p for t, p in self.predictions(ready).items()})

    def scores(self, df: DataFrame, function: metrics.Score = metrics.r2, keys: Sequence[str] = ()) -> DataFrame:
        """The score of every target, as columns named like the targets."""
        done = self.transform(df)
        exprs = [function(filled(done, t), filled(done, prediction_name(t))).alias(t) for t in self.targets]
        return done.groupBy(*keys).agg(*exprs)

    def score(self, df: DataFrame, function: metrics.Score = metrics.r2) -> float:
        values = [v for v in self.scores(df, function).first() if v is not None and not math.isnan(v)]
        return float(np.mean(values))


def solve(found: Moments, features: Sequence[str], target: str, ridge: float = 0.0) -> tuple[np.ndarray, float, float]:
    """Least-squares weights, intercept and R2 from means and covariances alone."""
    width = len(features)
    part = found.pick([*features, target])
    xx, xy, yy = part.cov[:width, :width], part.cov[:width, width], part.cov[width, width]
    if ridge:
        xx_used = xx + ridge / found.n * np.eye(width)
    else:
        xx_used = xx
    weights = np.linalg.lstsq(xx_used, xy, rcond=1e-12)[0]
    intercept = part.mean[width] - weights @ part.mean[:width]
    left = yy - 2 * weights @ xy + weights @ xx @ weights
    return weights, float(intercept), float(1 - left / yy) if yy > 0 else 0.0


@dataclass(frozen=True)
class LinearRegressor(Regressor):
    """Least squares (or ridge) for every target from one aggregate pass; scoring is a plain expression."""

    ridge: float = 0.0
    weights: Mapping[str, list[float]] | None = None
    intercepts: Mapping[str, float] | None = None
    spread: Mapping[str, float] | None = None
    fitted_score: Mapping[str, float] | None = None
    mean: Mapping[str, float] | None = None
    variance: Mapping[str, float] | None = None

    def fit(self, df: DataFrame) -> LinearRegressor:
        ready = self.ready(df)
        names = [*dict.fromkeys([*self.features, *self.targets])]
        return self.from_moments(moments(ready, names))

    def from_moments(self, found: Moments) -> LinearRegressor:
        solved = {t: solve(found, self.features, t, self.ridge) for t in self.targets}
        at = {c: i for i, c in enumerate(found.names)}
        total = {t: float(found.cov[at[t], at[t]]) for t in self.targets}
        return replace(
            self,
            weights={t: [float(w) for w in s[0]] for t, s in solved.items()},
            intercepts={t: s[1] for t, s in solved.items()},
            spread={t: math.sqrt(max(0.0, (1 - s[2]) * total[t])) for t, s in solved.items()},
            fitted_score={t: s[2] for t, s in solved.items()},
            mean={c: float(found.mean[at[c]]) for c in self.features},
            variance={c: float(found.cov[at[c], at[c]]) for c in self.features},
        )

    def predictions(self, df: DataFrame) -> dict[str, Column]:
        if self.weights is None:
            raise ValueError("fit first")
        return {
            t: reduce(operator.add, [F.lit(w) * filled(df, c) for w, c in zip(self.weights[t], self.features)],
                      F.lit(self.intercepts[t]))
            for t in self.targets
        }

    def confidence(self, df: DataFrame, target: str) -> Column:
        return metrics.confidence(df, self.features, self.mean, self.variance, self.spread[target])

    def contributions(self, df: DataFrame, target: str) -> DataFrame:
        """Mean of ``weight * (x - fitted mean)`` per feature over the given rows."""
        pairs = list(zip(self.weights[target], self.features))
        row = df.agg(*[(F.lit(w) * (F.avg(filled(df, c)) - F.lit(self.mean[c]))).alias(f"e{i}")
                       for i, (w, c) in enumerate(pairs)])
        return row.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"e{i}").alias("importance")) for i, (_, c) in enumerate(pairs)
        ])))

    def coefficients(self, spark) -> DataFrame:
        rows = [(t, c, float(w)) for t in self.targets for w, c in zip(self.weights[t], self.features)]
        rows += [(t, "1", float(self.intercepts[t])) for t in self.targets]
        return spark.createDataFrame(rows, "target string, feature string, weight double")


@dataclass(frozen=True)
class GroupedRegressor(Regressor):
    """One linear model per group value.

    Sums per group are built by ordinary aggregation, so a large group is never in one place; each group's
    small equation system is then solved on its single row. The model is a table: key, n, weights,
    intercepts, scores.
    """

    key: str = "group"
    ridge: float = 0.0
    table: DataFrame | None = None
    small: bool = True

    def table_schema(self, df: DataFrame) -> str:
        key = df.schema[self.key].dataType.simpleString()
        return (f"`{self.key}` {key}, n bigint, weights array<array<double>>, intercepts array<double>, "
                "scores array<double>, mean array<double>, variance array<double>, spread array<double>")

    def fit(self, df: DataFrame) -> GroupedRegressor:
        ready = self.ready(df).where(q(self.key).isNotNull())
        names = [*dict.fromkeys([*self.features, *self.targets])]
        key, features, targets, ridge, width = self.key, self.features, self.targets, self.ridge, len(names)

        def solve_rows(batches):
            for pdf in batches:
                rows = []
                for group, n, mean, cov in zip(pdf[key], pdf["n"], pdf["mean"], pdf["cov"]):
                    found = Moments(tuple(names), int(n), np.array(mean), np.array(cov, float).reshape(width, width))
                    solved = [solve(found, features, t, ridge) for t in targets]
                    at = [names.index(c) for c in features]
                    end = [names.index(t) for t in targets]
                    rows.append((
                        group, int(n), [s[0].tolist() for s in solved], [s[1] for s in solved], [s[2] for s in solved],
                        found.mean[at].tolist(), np.diag(found.cov)[at].tolist(),
                        [math.sqrt(max(0.0, (1 - s[2]) * found.cov[e, e])) for s, e in zip(solved, end)],
                    ))
                yield pd.DataFrame(rows, columns=[key, "n", "weights", "intercepts", "scores", "mean", "variance", "spread"])

        table = cut_lineage(moments_table(ready, names, [key]).mapInPandas(solve_rows, self.table_schema(df)))
        return replace(self, table=table, small=fits(table, BROADCAST_ROWS))

    def scored(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Rows with the model columns of their group; rows of unknown groups drop out."""
        model = self.table.select(q(self.key), *[q(c).alias(f"_{c}") for c in columns])
        rows = self.ready(df)
        if self.small:
            return rows.join(F.broadcast(model), self.key, "inner")
        if rows.isStreaming:
            return rows.join(model, self.key, "inner")
        return salted_join(rows, model, [self.key], "inner")

    def transform(self, df: DataFrame) -> DataFrame:
        if self.table is None:
            raise ValueError("fit first")
        ready = self.ready(df)
        names, wide = ready.columns, len(self.features) > WIDE
        if wide:  # the features travel as one column, the others only if they are asked for
            ready = with_all(ready, {self.key: apart(q(self.key)), "_x": packed(ready, self.features)})
        joined = self.scored(ready, ["weights", "intercepts"])
        values = [F.get("_x", F.lit(j)) if wide else filled(joined, c) for j, c in enumerate(self.features)]
        predicted = [
            reduce(operator.add, [F.get(F.get("_weights", F.lit(i)), F.lit(j)) * x for j, x in enumerate(values)],
                   apart(F.get("_intercepts", F.lit(i))) if wide else F.get("_intercepts", F.lit(i))).alias(prediction_name(t))
            for i, t in enumerate(self.targets)
        ]
        return joined.select(*[q(c) for c in names], *predicted)

    def score_table(self, df: DataFrame, function: metrics.Score = metrics.r2) -> DataFrame:
        """One row per group, one score per target."""
        return self.scores(df, function, [self.key])

    def confident(self, df: DataFrame, target: str, name: str = "confidence") -> DataFrame:
        joined = self.scored(df, ["mean", "variance", "spread"])
        at = {c: F.lit(j) for j, c in enumerate(self.features)}
        value = metrics.confidence(
            joined, self.features, {c: F.get("_mean", at[c]) for c in self.features},
            {c: F.get("_variance", at[c]) for c in self.features},
            F.get("_spread", F.lit(self.targets.index(target))),
        )
        return joined.select(*[q(c) for c in df.columns], value.alias(name))


def grouped_training(
    df: DataFrame, key: str, features: Sequence[str], targets: Sequence[str], split: str, ridge: float = 0.0,
    train_value: str = "train",
) -> tuple[GroupedRegressor, DataFrame]:
    """Models fitted on the training rows of each group, and R2 by group and split."""
    fitted = GroupedRegressor(tuple(features), tuple(targets), key, ridge).fit(df.where(q(split) == train_value))
    return fitted, fitted.scores(df, metrics.r2, [key, split])


@dataclass(frozen=True)
class SparkRegressor(Regressor):
    """Any Spark ML regressor, one per target."""

    build: Callable[[], Estimator] | None = None
    fitted: Mapping[str, Transformer] = field(default_factory=dict)

    needed_to_fit = ("build",)

    def assembled(self, df: DataFrame) -> DataFrame:
        zeroed = with_all(df, {f"_x{i}": filled(df, c) for i, c in enumerate(self.features)})
        inputs = [f"_x{i}" for i in range(len(self.features))]
        return VectorAssembler(inputCols=inputs, outputCol="_features").transform(zeroed).drop(*inputs)

    def fit(self, df: DataFrame) -> SparkRegressor:
        ready = self.ready(df)
        rows = self.assembled(with_all(ready, {t: filled(ready, t) for t in self.targets}))
        # solvers read the rows many times; what does not fit in memory goes to disk
        rows = rows.select("_features", *[q(t) for t in self.targets]).persist()
        try:
            done = {
                t: self.build().setFeaturesCol("_features").setLabelCol(t).setPredictionCol(prediction_name(t)).fit(rows)
                for t in self.targets
            }
        finally:
            rows.unpersist()
        return replace(self, fitted=done)

    def transform(self, df: DataFrame) -> DataFrame:
        ready = self.ready(df)
        out = self.assembled(ready.drop(*[prediction_name(t) for t in self.targets]))
        for t in self.targets:
            out = self.fitted[t].transform(out)
        return out.drop("_features")

    def importances(self, spark, target: str) -> DataFrame:
        values = self.fitted[target].featureImportances.toArray()
        rows = [(c, float(v)) for c, v in zip(self.features, values)]
        return spark.createDataFrame(rows, "feature string, importance double")


@dataclass(frozen=True)
class StackedRegressor(Regressor):
    """Predictions of base models are the features of a second model.

    ``frozen`` bases are already fitted and used as they are.
    """

    bases: tuple[Regressor, ...] = ()
    ridge: float = 0.0
    frozen: bool = False
    meta: LinearRegressor | None = None

    def base_names(self) -> list[str]:
        return [f"_base{k}_{t}" for k in range(len(self.bases)) for t in self.targets]

    def with_bases(self, df: DataFrame) -> DataFrame:
        out = self.ready(df)
        for k, base in enumerate(self.bases):
            kept = out.columns
            done = base.transform(out)
            out = done.select(
                *[q(c) for c in kept if c not in {prediction_name(t) for t in self.targets}],
                *[q(prediction_name(t)).alias(f"_base{k}_{t}") for t in self.targets],
            )
        return out

    def fit(self, df: DataFrame) -> StackedRegressor:
        bases = self.bases if self.frozen else tuple(b.fit(df) for b in self.bases)
        stacked = replace(self, bases=bases)
        meta = LinearRegressor(tuple(self.base_names()), self.targets, self.ridge).fit(stacked.with_bases(df))
        return replace(stacked, meta=meta)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.meta.transform(self.with_bases(df)).drop(*self.base_names())


@dataclass(frozen=True)
class FactoredRegressor(Regressor):
    """Predictions times factors; a factor is the row sum of the columns an operator adds.

    Sums that are not positive count as 1.
    """

    base: Regressor | None = None
    factors: tuple[Operator, ...] = ()

    def factor(self, df: DataFrame, step: Operator) -> tuple[DataFrame, Column]:
        done = step(df)
        added = [c for c in done.columns if c not in df.columns]
        total = reduce(operator.add, [filled(done, c) for c in added], F.lit(0.0))
        return done, F.when(total > 0, total).otherwise(1.0)

    def fit(self, df: DataFrame) -> FactoredRegressor:
        steps = tuple(s.fit(df) for s in self.factors)
        return replace(self, factors=steps, base=self.base.fit(df))

    def transform(self, df: DataFrame) -> DataFrame:
        ready, product = self.ready(df), F.lit(1.0)
        frame = ready
        for step in self.factors:
            frame, f = self.factor(frame, step)
            product = product * f
        done = self.base.transform(frame.withColumn("_factor", product))
        scaled = with_all(done, {
            prediction_name(t): q(prediction_name(t)) * F.col("_factor") for t in self.targets
        })
        return scaled.select(*[q(c) for c in ready.columns], *[q(prediction_name(t)) for t in self.targets])


@dataclass(frozen=True)
class DefaultedRegressor(Regressor):
    """Columns whose name contains a key are set to that key's constant before fit and predict."""

    base: Regressor | None = None
    defaults: Mapping[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> DefaultedRegressor:
        return replace(self, base=self.base.fit(SetByName(self.defaults).transform(self.ready(df))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.base.transform(SetByName(self.defaults).transform(self.ready(df)))
