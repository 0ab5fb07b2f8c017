"""Encoding once per group, averaging embeddings, grids from embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import arrays
from loomwright.operators.lookup import vectors_of_groups
from loomwright.plans.columns import containing, q, with_all
from loomwright.plans.joins import salted_join
from loomwright.plans.operator import Operator

# An encoder turns rows (value) into rows (value, vector array<double>).
Encoder = Callable[[DataFrame], DataFrame]


def token_counts(width: int = 512) -> Encoder:
    """Hashed word counts over the whole text, by Spark ML."""

    def encode(values: DataFrame) -> DataFrame:
        words = values.withColumn("_words", F.filter(F.split(F.lower("value"), r"\s+"), lambda w: w != ""))
        counted = HashingTF(numFeatures=width, inputCol="_words", outputCol="_counts").transform(words)
        return counted.select("value", vector_to_array("_counts").alias("vector"))

    return encode


def column_encoder(build: Callable[[Column], Column]) -> Encoder:
    """An encoder from a column expression (a Pandas UDF counts as one)."""
    return lambda values: values.select("value", build(F.col("value")).cast("array<double>").alias("vector"))


@dataclass(frozen=True)
class EncodeOnce(Operator):
    """Encode the first value (or list of values) of each group and put the vector on every row of it.

    Each distinct value is encoded once. Lists are averaged. ``normalize`` divides by the norm; values that
    cannot be encoded give NULL. Output ``<column>_clip``.
    """

    columns: tuple[str, ...]
    key: str
    order_by: tuple[str, ...]
    encoder: Encoder = field(default_factory=token_counts)
    normalize: bool = True
    after: Callable[[Column], Column] | None = None

    whole_table = True

    def transform(self, df: DataFrame) -> DataFrame:
        vectors = vectors_of_groups(df, self.columns, self.key, self.order_by, self.encoder, "value", "vector")
        made = {}
        for c in self.columns:
            vector = q(f"{c}_clip")
            if self.normalize:
                vector = F.when(vector.isNotNull(), arrays.unit(vector))
            if self.after is not None:
                vector = F.when(q(f"{c}_clip").isNotNull(), self.after(vector))
            made[f"{c}_clip"] = vector
        out = salted_join(df, with_all(vectors, made), [self.key], "left")
        return out.select(*[q(c) for c in df.columns], *[q(f"{c}_clip") for c in self.columns])


@dataclass(frozen=True)
class AverageVectors(Operator):
    """Mean of several vectors of a row, missing ones as zeros, divided by its norm.

    A vector is an array column, or the group of number columns that share a part of their name.
    """

    columns: tuple[str, ...]
    width: int
    name: str | None = None
    as_array: bool = True

    def vector(self, df: DataFrame, column: str) -> Column:
        if column in df.columns:
            return q(column)
        part = column if "clip" in column else f"{column}_clip"
        group = sorted(containing(df, part), key=lambda c: int(c.rsplit("_", 1)[1]))
        if len(group) != self.width:
            return F.lit(None).cast("array<double>")
        return F.array(*[q(c).cast("double") for c in group])

    def transform(self, df: DataFrame) -> DataFrame:
        stem = self.name or "_".join(c.replace("_clip", "") for c in self.columns)
        mean = arrays.mean_of([self.vector(df, c) for c in self.columns], self.width)
        out = f"{stem}__avg_clip"
        done = df.withColumn(out, arrays.unit(mean))
        if self.as_array:
            return done
        return Spread((out,), self.width, joiner="_").transform(done).drop(out)


@dataclass(frozen=True)
class Pack(Operator):
    """Number columns as one array column, named after what their names share."""

    columns: tuple[str, ...]
    name: str | None = None
    drop: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        name = self.name or arrays.root_name(self.columns) or f"{self.columns[0]}_concat"
        packed = with_all(df, {name: F.array(*[q(c) for c in self.columns])})
        return packed.drop(*[c for c in self.columns if c != name]) if self.drop else packed


@dataclass(frozen=True)
class Spread(Operator):
    """An array column as number columns ``<c>_clip_<j>``."""

    columns: tuple[str, ...]
    width: int
    joiner: str = "_clip_"

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {
            f"{c}{self.joiner}{j}": F.get(q(c), F.lit(j)) for c in self.columns for j in range(self.width)
        })


@dataclass(frozen=True)
class First(Operator):
    """List columns replaced by their first element."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: F.get(q(c), F.lit(0)) for c in self.columns})


@dataclass(frozen=True)
class Unit(Operator):
    """Vectors divided by their norm."""

    columns: tuple[str, ...]
    order: int = 2

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: arrays.unit(q(c), self.order) for c in self.columns})


@dataclass(frozen=True)
class OverlapGrid(Operator):
    """Vectors as square grids of overlapping windows, ``<c>_2d`` in row-major order.

    ``cells`` names the window position of each block cell and ``weights`` its weight.
    """

    columns: tuple[str, ...]
    width: int
    size: int = 256
    stride: int = 128
    padding: int = 64
    weights: Sequence[float] | None = None
    cells: Sequence[int] | None = None

    def edge_and_taps(self):
        side = round(self.size**0.5)
        weights = self.weights if self.weights is not None else arrays.gaussian_window(side)
        return arrays.overlap_taps(self.width, self.size, self.stride, self.padding, weights, self.cells)

    def transform(self, df: DataFrame) -> DataFrame:
        _, taps = self.edge_and_taps()
        return with_all(df, {f"{c}_2d": arrays.overlap_add(q(c), taps) for c in self.columns})
