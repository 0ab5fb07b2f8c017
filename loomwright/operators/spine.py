"""Regular time grids per group."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.aggregate import _all_known
from loomwright.operators.select import FillMissing
from loomwright.plans.columns import q, type_of
from loomwright.plans.operator import Operator

# Frequency letters and the intervals they stand for.
UNITS = {
    "D": "day", "W": "week", "H": "hour", "h": "hour", "T": "minute", "min": "minute", "S": "second", "s": "second",
    "MS": "month", "QS": "quarter", "YS": "year",
}


MICROS = {
    "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000,
}


def step_of(freq: str) -> tuple[int, str]:
    count, letters = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", freq.strip()).groups()
    return int(count or 1), UNITS[letters]


MONTHS = {"month": 1, "quarter": 3, "year": 12}
# steps that are made from one row at a time
BLOCK = 4_096


@dataclass(frozen=True)
class TimeGrid(Operator):
    """For every group one row per grid step; steps without data get 0.

    Rows on the grid pass through as they are. Only group keys and numbers of steps are shuffled, to find the
    steps that have no row: a group's steps are made in blocks of ``BLOCK``, spread over the tasks, so memory does not
    grow with the length of the grid. Rows off the grid are lost, unless ``truncate`` moves each back to the last step
    before it. Rows before the start or behind the end are lost in any case.
    """

    column: str
    keys: tuple[str, ...]
    freq: str = "1D"
    start: str | None = None
    end: str | None = None
    truncate: bool = False

    whole_table = True

    def moment(self, df: DataFrame) -> Column:
        moment = q(self.column)
        return moment if isinstance(type_of(df, self.column), T.TimestampNTZType) else moment.cast("timestamp_ntz")

    def fit(self, df: DataFrame) -> TimeGrid:
        if self.start is not None and self.end is not None:
            return self
        moment = self.moment(df)
        if self.truncate:  # the grid begins at a whole unit
            moment = F.date_trunc(step_of(self.freq)[1], moment).cast("timestamp_ntz")
        low, high = df.agg(F.min(moment).cast("string"), F.max(self.moment(df)).cast("string")).first()
        return TimeGrid(self.column, self.keys, self.freq, self.start or low, self.end or high, self.truncate)

    def ends(self) -> tuple[Column, Column]:
        return F.lit(self.start).cast("timestamp_ntz"), F.lit(self.end).cast("timestamp_ntz")

    def number(self, moment: Column) -> Column:
        """The number of the last step at or before a moment that is not before the start."""
        count, unit = step_of(self.freq)
        start, _ = self.ends()
        if unit in MICROS:
            return F.call_function("div", F.timestamp_diff("MICROSECOND", start, moment), F.lit(count * MICROS[unit]).cast("long"))
        return F.call_function("div", F.timestamp_diff("MONTH", start, moment), F.lit(count * MONTHS[unit]).cast("long"))

    def stamp(self, number: Column) -> Column:
        count, unit = step_of(self.freq)
        start, _ = self.ends()
        if unit in MICROS:
            return F.timestamp_add("MICROSECOND", number * F.lit(count * MICROS[unit]).cast("long"), start)
        return F.timestamp_add("MONTH", (number * F.lit(count * MONTHS[unit])).cast("int"), start)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.start is None or self.end is None:
            raise ValueError("fit first: the grid has no ends")
        keys, (start, end) = [*self.keys], self.ends()
        moment = self.moment(df)
        rows = df.withColumn(self.column, moment).where(_all_known(self.keys))
        inside = rows.where((q(self.column) >= start) & (q(self.column) <= end))
        step = self.stamp(self.number(q(self.column)))
        present = inside.withColumn(self.column, step) if self.truncate else inside.where(q(self.column) == step)
        size = F.lit(BLOCK).cast("long")
        last = self.number(end)
        seen = present.select(*[q(k) for k in keys], self.number(q(self.column)).alias("_step")).distinct()
        blocks = seen.groupBy(*keys, F.call_function("div", F.col("_step"), size).alias("_block")).agg(F.collect_list("_step").alias("_seen"))
        groups = rows.select(*[q(k) for k in keys]).distinct()
        numbers = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", last, size))))
        # by a number of parts, as blocks are too few bytes to be left apart otherwise
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wanted = numbers.repartition(parts, *keys, "_block").join(blocks, [*keys, "_block"], "left")
        steps = F.sequence(F.col("_block") * size, F.least(last, (F.col("_block") + 1) * size - 1))
        left = F.when(F.col("_seen").isNull(), steps).otherwise(F.array_except(steps, "_seen"))
        absent = wanted.select(*[q(k) for k in keys], F.explode(left).alias("_step")).select(
            *[q(k) for k in keys], self.stamp(F.col("_step")).alias(self.column))
        filled = FillMissing(columns=tuple(c for c in df.columns if c not in (*self.keys, self.column)))
        return filled.transform(present.unionByName(absent, allowMissingColumns=True).select(*[q(c) for c in df.columns]))
