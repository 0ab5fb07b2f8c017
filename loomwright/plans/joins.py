"""Joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.plans.columns import q

ROWS_PER_TASK = 2_000_000
BROADCAST_ROWS = 50_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the table is proven to hold at most ``rows`` rows.

    ``take`` opens splits until it has enough, so a huge table costs no more than a short one.
    """
    return len(df.select(F.lit(1)).take(rows + 1)) <= rows


# what tells rows apart best, first; two such columns are enough and keep the scan narrow
TELLING = (T.LongType, T.TimestampNTZType, T.TimestampType, T.DoubleType, T.IntegerType, T.NumericType, T.DateType)


def spread(df: DataFrame, keys: Sequence[str]) -> Column:
    """A number that differs between rows of one key and is the same again when a task is retried.

    Two short columns are hashed, long ones only when there is nothing else. Exact copies differ by the
    input split they come from.
    """
    fields = [f for f in df.schema.fields if f.name not in keys]
    short = [f for kind in TELLING for f in fields if isinstance(f.dataType, kind)]
    usable = list(dict.fromkeys(f.name for f in short))[:2] or [
        f.name for f in fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.spark_partition_id(), *[q(c) for c in usable])


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join of a row table with a table that is keyed by ``keys``.

    Keys with more than ``rows_per_task`` rows are cut into as many slices as needed and the
    lookup rows of those keys are repeated once per slice. Every such key is sliced; there are at most
    rows / rows_per_task of them, which bounds the broadcast list.
    """
    keys = list(keys)
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep the row side whole")
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot_names = [f"_hot_{i}" for i in range(len(keys))]
    hot = (
        counts.where(F.col("_n") > rows_per_task)
        .select(
            *[q(k).alias(h) for k, h in zip(keys, hot_names)],
            F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_slices"),
        )
    )
    same = [q(k).eqNullSafe(F.col(h)) for k, h in zip(keys, hot_names)]
    condition = same[0]
    for extra in same[1:]:
        condition = condition & extra
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    marked = rows.join(F.broadcast(hot), condition, "left")
    own_slice = F.when(slices > 1, F.pmod(spread(rows, keys), slices).cast("int")).otherwise(0)
    left = marked.withColumn("_slice", own_slice).drop("_slices", *hot_names)
    right = (
        lookup.join(F.broadcast(hot), condition, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices", *hot_names)
    )
    return left.join(right, [*keys, "_slice"], how).drop("_slice")

