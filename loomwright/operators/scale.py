"""Scaling of numeric columns in place, and column-wise Spark ML estimators."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import mathops
from loomwright.plans.columns import filled, lit_array, number, q, with_all
from loomwright.plans.operator import Operator
from loomwright.plans.ordered import exact_quantiles, range_bin

# Probabilities are kept this far from 0 and 1 before the inverse normal.
TAIL = 1e-7
NORMAL_LIMIT = 5.199337582605575


@dataclass(frozen=True)
class Linear(Operator):
    """``(x - centre) / width`` per column; a width of 0 counts as 1."""

    columns: tuple[str, ...]
    centre: Mapping[str, float] | None = None
    width: Mapping[str, float] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.centre is None:
            raise ValueError("fit first")
        return with_all(df, {
            c: (number(df, c) - F.lit(self.centre[c])) / F.lit(self.width[c]) for c in self.columns
        })

    def inverse(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: number(df, c) * F.lit(self.width[c]) + F.lit(self.centre[c]) for c in self.columns})

    def stated(self, centre: Mapping, width: Mapping) -> Linear:
        return replace(
            self, centre={c: float(centre[c] or 0.0) for c in self.columns},
            width={c: float(width[c] or 1.0) for c in self.columns},
        )


@dataclass(frozen=True)
class RobustScale(Linear):
    """Median and interquartile range."""

    def fit(self, df: DataFrame) -> RobustScale:
        found = exact_quantiles(df, self.columns, [0.25, 0.5, 0.75])
        return self.stated(
            {c: found[c][1] for c in self.columns},
            {c: (found[c][2] or 0) - (found[c][0] or 0) for c in self.columns},
        )


@dataclass(frozen=True)
class MinMaxScale(Linear):
    """Smallest value and range."""

    def fit(self, df: DataFrame) -> MinMaxScale:
        row = df.agg(
            *[F.min(number(df, c)).alias(f"lo{i}") for i, c in enumerate(self.columns)],
            *[F.max(number(df, c)).alias(f"hi{i}") for i, c in enumerate(self.columns)],
        ).first()
        low = {c: row[f"lo{i}"] for i, c in enumerate(self.columns)}
        return self.stated(low, {c: (row[f"hi{i}"] or 0) - (low[c] or 0) for i, c in enumerate(self.columns)})


@dataclass(frozen=True)
class StandardScale(Linear):
    """Mean and sample standard deviation."""

    def fit(self, df: DataFrame) -> StandardScale:
        row = df.agg(
            *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(self.columns)],
            *[F.stddev_samp(number(df, c)).alias(f"s{i}") for i, c in enumerate(self.columns)],
        ).first()
        return self.stated(
            {c: row[f"m{i}"] for i, c in enumerate(self.columns)},
            {c: row[f"s{i}"] for i, c in enumerate(self.columns)},
        )


@dataclass(frozen=True)
class QuantileUniform(Operator):
    """Place of a value in the fitted distribution, between 0 and 1.

    ``landmarks`` exact quantiles are kept per column; values between two of them are interpolated and
    a value that equals several landmarks gets their middle.
    """

    columns: tuple[str, ...]
    landmarks: int = 1_000
    table: Mapping[str, list[float]] | None = None

    def fit(self, df: DataFrame) -> QuantileUniform:
        # only whether there are fewer rows than landmarks matters, so a few splits are enough
        rows = len(df.select(F.lit(1)).take(self.landmarks))
        count = max(2, rows)
        probs = [k / (count - 1) for k in range(count)]
        return replace(self, table=exact_quantiles(df, self.columns, probs))

    def place(self, value: Column, at: Column, marks: list[float]) -> Column:
        """Place of a value, given how many landmarks are at or below it."""
        last = len(marks) - 1
        table, tied = lit_array(marks), lit_array([(marks.index(m) + i) / 2 / last for i, m in enumerate(marks)])
        low = F.get(table, at - 1)
        part = (value - low) / (F.get(table, at) - low)
        return (
            F.when(value <= marks[0], 0.0).when(value >= marks[-1], 1.0)
            .when(value == low, F.get(tied, at - 1))
            .when(value.isNotNull(), (at - 1 + part) / F.lit(float(last)))
        )

    def places(self, df: DataFrame) -> DataFrame:
        if self.table is None:
            raise ValueError("fit first")
        found = with_all(df, {f"_at_{c}": range_bin(number(df, c), self.table[c]) for c in self.columns})
        placed = with_all(found, {c: self.place(number(df, c), q(f"_at_{c}"), self.table[c]) for c in self.columns})
        return placed.drop(*[f"_at_{c}" for c in self.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.places(df)


@dataclass(frozen=True)
class QuantileNormal(QuantileUniform):
    """The same place, read off a standard normal distribution; the ends are cut off."""

    def transform(self, df: DataFrame) -> DataFrame:
        inside = {c: F.least(F.greatest(q(c), F.lit(TAIL)), F.lit(1 - TAIL)) for c in self.columns}
        placed = self.places(df)
        ready = with_all(placed, {f"_tail_{c}": mathops.probit_tail(p) for c, p in inside.items()})
        return with_all(ready, {
            c: F.when(q(c) <= TAIL, F.lit(-NORMAL_LIMIT)).when(q(c) >= 1 - TAIL, F.lit(NORMAL_LIMIT))
            .when(q(c).isNotNull(), mathops.probit(q(c), q(f"_tail_{c}")))
            for c in self.columns
        }).drop(*[f"_tail_{c}" for c in self.columns])


def scaler(kind: str | None, columns: tuple[str, ...], **settings) -> Operator:
    """Scaler by name; robust scaling when the name says nothing."""
    name = (kind or "").lower()
    choices: list[tuple[tuple[str, ...], Callable[..., Operator]]] = [
        (("normal",), QuantileNormal),
        (("quantile", "uniform"), QuantileUniform),
        (("robust",), RobustScale),
        (("minmax", "maxmin"), MinMaxScale),
        (("standard",), StandardScale),
    ]
    for parts, build in choices:
        if any(p in name for p in parts):
            return build(tuple(columns), **settings)
    return RobustScale(tuple(columns))


@dataclass(frozen=True)
class PerColumn(Operator):
    """Any Spark ML estimator on every column by itself; output ``<c>_transformed[_j]``.

    The stages of all columns are fitted as one pipeline over one assembled table, and one pass tells how many numbers
    each of them gives.
    """

    columns: tuple[str, ...]
    build: Callable[[str, str], Estimator | Transformer] | None = None
    drop_original: bool = True
    fitted: Mapping[str, tuple[Transformer, int]] | None = None

    needed_to_fit = ("build",)

    def assembled(self, df: DataFrame) -> DataFrame:
        """One vector column ``_in<i>`` of one number per column, made by plain expressions."""
        return df.select(*[q(c) for c in df.columns], *[
            array_to_vector(F.array(filled(df, c))).alias(f"_in{i}") for i, c in enumerate(self.columns)])

    def fit(self, df: DataFrame) -> PerColumn:
        ready = self.assembled(df.select(*[q(c) for c in self.columns])).persist()
        try:
            models = Pipeline(stages=[self.build(f"_in{i}", f"_out{i}") for i in range(len(self.columns))]).fit(ready).stages
            sample = ready.limit(1)
            for model in models:
                sample = model.transform(sample)
            row = sample.select(*[F.size(vector_to_array(f"_out{i}")) for i in range(len(self.columns))]).first()
        finally:
            ready.unpersist()
        if row is None:
            raise ValueError("no rows to fit on")
        return replace(self, fitted={c: (model, int(n)) for c, model, n in zip(self.columns, models, row)})

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise ValueError("fit first")
        out, new = self.assembled(df), []
        for i, c in enumerate(self.columns):
            model, width = self.fitted[c]
            out = model.transform(out)
            names = [f"{c}_transformed"] if width == 1 else [f"{c}_transformed_{j}" for j in range(width)]
            new += [F.get(vector_to_array(f"_out{i}"), F.lit(j)).alias(n) for j, n in enumerate(names)]
        kept = [c for c in df.columns if not (self.drop_original and c in self.columns)]
        return out.select(*[q(c) for c in kept], *new)
