"""Distances between two samples of a number."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.aggregate import histogram
from loomwright.plans.columns import number
from loomwright.plans.ordered import running_totals
from loomwright.session import stored


def kl(p: Column, q: Column) -> Column:
    return F.sum(p * F.log(p / q))


def js(p: Column, q: Column) -> Column:
    middle = (p + q) / 2
    return F.sum(p * F.log(p / middle) + q * F.log(q / middle)) / 2


def sample(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.select(number(df, column).alias(name)).where(F.col(name).isNotNull())


def shared_histogram(first: DataFrame, second: DataFrame, bins: int = 10, column: str = "value") -> DataFrame:
    """Bin shares ``p`` and ``q`` of both samples on their common range; bins that both fill."""
    ends = (
        first.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        .unionByName(second.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
        .agg(F.min("lo"), F.max("hi")).first()
    )
    if ends[0] is None:
        raise ValueError("both samples are empty")
    low, high = float(ends[0]), float(ends[1])
    if low == high:
        low, high = low - 1.0, high + 1.0
    p = histogram(first, column, bins, low, high).select("bin", F.col("p"))
    q = histogram(second, column, bins, low, high).select("bin", F.col("p").alias("q"))
    return p.join(q, "bin").where((F.col("p") > 0) & (F.col("q") > 0))


def divergences(
    first: DataFrame, second: DataFrame, functions: Mapping[str, Callable[[Column, Column], Column]], bins: int = 10,
    column: str = "value",
) -> DataFrame:
    """One row with a column per divergence of the shared histogram; any aggregate of p and q will do."""
    joined = shared_histogram(first, second, bins, column)
    return joined.agg(*[f(F.col("p"), F.col("q")).alias(n) for n, f in functions.items()])


def wasserstein(first: DataFrame, second: DataFrame, column: str = "value") -> DataFrame:
    """Area between the two distribution functions, exact.

    Equal values are counted before anything is sorted; see ``running_totals`` for the order.
    """
    one, zero = F.lit(1), F.lit(0)
    both = first.select(F.col(column).alias("value"), one.alias("a"), zero.alias("b")).unionByName(
        second.select(F.col(column).alias("value"), zero.alias("a"), one.alias("b"))
    )
    per_value = stored(both.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "value-counts")
    sizes = per_value.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    ran = running_totals(per_value, "value", ["a", "b"])
    gap = F.abs(F.col("running_a") / F.col("na") - F.col("running_b") / F.col("nb"))
    return ran.join(F.broadcast(sizes)).agg(
        F.coalesce(F.sum(gap * (F.col("next_value") - F.col("value"))), F.lit(0.0)).alias("distance")
    )


def wasserstein_of_heights(first: DataFrame, second: DataFrame, bins: int = 10, column: str = "value") -> DataFrame:
    """The distance applied to the two lists of bin shares; where the bins lie plays no part."""
    heights = shared_histogram(first, second, bins, column)
    return wasserstein(
        heights.select(F.col("p").alias("value")), heights.select(F.col("q").alias("value"))
    )
