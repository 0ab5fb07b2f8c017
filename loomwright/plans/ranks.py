"""Places of rows in their order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.plans.columns import q
from loomwright.session import stored

PART = "_range"


def _in_part(keys: Sequence[str], offsets: DataFrame) -> Column:
    same = F.col(PART) == offsets["_part"]
    for k, name in enumerate(keys):
        same = same & q(name).eqNullSafe(offsets[f"_key_{k}"])
    return same


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank", tie: str | None = None) -> DataFrame:
    """``df`` with the place of each row in its group, from 0, in the given order.

    Without keys all rows are one group. Rows are dealt into ranges of (keys, order), so a group of any size is spread
    over many tasks; places inside a range are counted there, and the rows of the group in earlier ranges are added.
    Only groups that reach over the end of a range need that, so the list of additions has fewer entries than there
    are ranges, which bounds its broadcast. Rows that are equal in keys and order stay in one range, unless ``tie``
    names a new column to number them by; its numbers then decide between equal rows.
    """
    keys = list(keys)
    if tie is not None:
        df = df.withColumn(tie, F.monotonically_increasing_id())
        order = [*order, F.col(tie)]
    ranges = df.repartitionByRange(*[q(k).asc_nulls_first() for k in keys], *order).withColumn(PART, F.spark_partition_id())
    dealt = stored(ranges, "ranges")
    local = Window.partitionBy(PART, *[q(k) for k in keys]).orderBy(*order)
    counts = dealt.groupBy(PART, *[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[q(k) for k in keys]).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.withColumn("_before", F.sum("_n").over(before)).where(F.col("_before") > 0)
               .select(F.col(PART).alias("_part"), *[q(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_before"))
    placed = dealt.withColumn("_place", F.row_number().over(local).cast("long") - 1)
    out = placed.join(F.broadcast(offsets), _in_part(keys, offsets), "left")
    place = F.col("_place") + F.coalesce("_before", F.lit(0).cast("long"))
    return out.select(*[q(c) for c in df.columns if c != tie], place.alias(name))
