"""Group aggregates, distinct values, per-item statistics and histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.plans.columns import NUMBERS, known, number, q, type_of
from loomwright.plans.joins import salted_join
from loomwright.plans.operator import Operator

Aggregate = str | Callable[[Column], Column]

SIMPLE: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_pop, "var": F.var_pop,
}


def order_key(order_by: Sequence[str]) -> Column:
    return q(order_by[0]) if len(order_by) == 1 else F.struct(*[q(c) for c in order_by])


@dataclass(frozen=True)
class GroupRows(Operator):
    """One row per group; the aggregate of a column follows from its name or its type.

    Flags and numbers are averaged, everything else takes the first value by ``order_by``. A column
    ``log_x`` next to ``x`` is rebuilt from the aggregated ``x``. ``count_column`` adds the group size.
    """

    keys: tuple[str, ...]
    columns: tuple[str, ...] = ()
    by_type: Mapping[str, Aggregate] = field(default_factory=dict)
    by_column: Mapping[str, Aggregate] = field(default_factory=dict)
    order_by: tuple[str, ...] = ()
    count_column: str | None = None

    whole_table = True

    def chosen(self, df: DataFrame, name: str) -> Aggregate:
        if name in self.by_column:
            return self.by_column[name]
        kind = type_of(df, name)
        if isinstance(kind, T.BooleanType):
            return self.by_type.get("bool", "mean")
        if isinstance(kind, NUMBERS):
            return self.by_type.get("number", "mean")
        return self.by_type.get("object", "first")

    def averaged(self, df: DataFrame) -> list[str]:
        return [c for c in self.value_columns(df) if self.chosen(df, c) == "mean"]

    def value_columns(self, df: DataFrame) -> list[str]:
        wanted = self.columns or df.columns
        return [c for c in df.columns if c in set(wanted) and c not in self.keys]

    def transform(self, df: DataFrame) -> DataFrame:
        firsts, exprs, names = [], [], self.value_columns(df)
        for c in names:
            base = c.removeprefix("log_")
            is_log = base != c and base in df.columns
            how = self.chosen(df, c)
            if how == "first":
                firsts.append(q(base).alias(c) if is_log else q(c))
                continue
            source = base if is_log else c
            numeric = isinstance(type_of(df, source), (*NUMBERS, T.BooleanType))
            # sums and extremes of whole numbers stay whole numbers
            whole = how in ("sum", "min", "max") and isinstance(type_of(df, source), (T.IntegralType, T.DecimalType))
            value = number(df, source) if numeric and not whole else q(source)
            result = (SIMPLE[how] if isinstance(how, str) else how)(value)
            exprs.append((F.log1p(result) if is_log else result).alias(c))
        if firsts:
            if not self.order_by:
                raise ValueError("columns taken from the first row need order_by")
            exprs.append(F.min_by(F.struct(*firsts), order_key(self.order_by)).alias("_first"))
        if self.count_column:
            exprs.append(F.count(F.lit(1)).alias(self.count_column))
        grouped = df.where(_all_known(self.keys)).groupBy(*self.keys).agg(*exprs)
        taken = {c for c in names if self.chosen(df, c) == "first"}
        logs = {c for c in taken if c.startswith("log_") and c.removeprefix("log_") in df.columns}
        picked = [
            (F.log1p(F.col("_first")[c]) if c in logs else F.col("_first")[c]).alias(c) if c in taken else q(c)
            for c in names
        ]
        tail = [q(self.count_column)] if self.count_column else []
        return grouped.select(*[q(k) for k in self.keys], *picked, *tail)


def _all_known(keys: Sequence[str]) -> Column:
    known_all = F.lit(True)
    for k in keys:
        known_all = known_all & q(k).isNotNull()
    return known_all


@dataclass(frozen=True)
class GroupValue(Operator):
    """An aggregate of each group on each of its rows; rows with a NULL key go, as in an inner merge."""

    keys: tuple[str, ...]
    function: Callable[[], Column] | None = None
    alias: str | None = None
    name: str = "len"

    whole_table = True

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.alias or "_".join(self.keys) + "_" + self.name
        value = self.function() if self.function else F.count(F.lit(1))
        rows = df.where(_all_known(self.keys))
        per_group = rows.groupBy(*self.keys).agg(value.alias(out), F.count(F.lit(1)).alias("_n"))
        joined = salted_join(rows, per_group.drop("_n"), self.keys, "inner", counts=per_group.drop(out))
        return joined.select(*[q(c) for c in df.columns if c != out], q(out))


@dataclass(frozen=True)
class OncePerGroup(Operator):
    """Apply an operator to the first row of each group and join what it adds back to all rows."""

    keys: tuple[str, ...]
    inner: Operator
    columns: tuple[str, ...]
    order_by: tuple[str, ...]

    whole_table = True

    def firsts(self, df: DataFrame) -> DataFrame:
        return first_rows(df, self.keys, self.columns, self.order_by)

    def fit(self, df: DataFrame) -> OncePerGroup:
        return OncePerGroup(self.keys, self.inner.fit(self.firsts(df)), self.columns, self.order_by)

    def transform(self, df: DataFrame) -> DataFrame:
        done = self.inner(self.firsts(df))
        new = [c for c in done.columns if c not in df.columns]
        joined = salted_join(df, done.select(*[q(k) for k in self.keys], *[q(c) for c in new]), self.keys, "left")
        return joined.select(*[q(c) for c in df.columns], *[q(c) for c in new])


def first_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Values of the first row of each group, NULLs included; ``order_by`` must tell rows apart.

    Long values (text, lists) are not carried through the aggregation: the first place of each group is
    found from keys and order alone and its row is then picked by a join.
    """
    rows = df.where(_all_known(keys))
    order = order_key(order_by)
    if len(columns) == 1 and is_short(df, columns[0]):
        return rows.groupBy(*keys).agg(F.min_by(q(columns[0]), order).alias(columns[0]))
    if any(not is_short(df, c) for c in columns):
        places = rows.groupBy(*keys).agg(F.min(order).alias("_place")).select(
            *[q(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_place")
        same = order.eqNullSafe(F.col("_place"))
        for i, k in enumerate(keys):
            same = same & (q(k) == F.col(f"_key_{i}"))
        rows = rows.join(places, same, "left_semi")
    first = F.min_by(F.struct(*[q(c) for c in columns]), order).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")


def is_short(df: DataFrame, column: str) -> bool:
    return not isinstance(type_of(df, column), (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def group_counts(df: DataFrame, keys: Sequence[str], column: str, name: str = "n") -> DataFrame:
    """Known values of ``column`` per group."""
    return df.where(_all_known(keys)).groupBy(*keys).agg(F.count(known(q(column), type_of(df, column))).alias(name))


def distinct_values(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.select(known(q(column), type_of(df, column)).alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(name)


def distinct_items(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Distinct elements over all lists; duplicates inside one list go before the shuffle."""
    items = df.select(F.explode(F.array_distinct(q(column))).alias(name)).where(F.col(name).isNotNull())
    return items.distinct().orderBy(name)


def feature_moments(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance of every feature, missing values skipped."""
    exprs = [e for c in features for e in (
        F.avg(number(df, c)).alias(f"mean_{c}"), F.var_pop(number(df, c)).alias(f"var_{c}"))]
    return df.groupBy(*keys).agg(*exprs)


def per_item(
    df: DataFrame, column: str, aggregates: Mapping[str, Column], items: DataFrame, item: str = "item",
    missing: float | None = None,
) -> DataFrame:
    """For each listed item, aggregates over the rows whose list contains it; one row per item.

    The rows are aggregated before they meet the item list, so a frequent item is just a large count.
    """
    used = sorted({c for c in df.columns if c != column})
    long = df.select(F.explode(F.array_distinct(q(column))).alias(item), *[q(c) for c in used])
    done = long.groupBy(item).agg(*[e.alias(n) for n, e in aggregates.items()])
    joined = items.select(item).distinct().join(done, item, "left")
    return joined.fillna(missing, list(aggregates)) if missing is not None else joined


def item_totals(df: DataFrame, column: str, values: Sequence[str], items: DataFrame, item: str = "item") -> DataFrame:
    sums = {f"{v}_distro": F.sum(number(df, v)) for v in values}
    return per_item(df, column, sums, items, item, missing=0.0)


def item_shares(df: DataFrame, column: str, values: Sequence[str], items: DataFrame, item: str = "item") -> DataFrame:
    """Item totals divided by their sum over all items."""
    totals = item_totals(df, column, values, items, item)
    names = [f"{v}_distro" for v in values]
    whole = totals.agg(*[F.sum(n).alias(f"_all_{n}") for n in names])
    return totals.join(F.broadcast(whole)).select(
        item, *[F.try_divide(F.col(n), F.col(f"_all_{n}")).alias(n) for n in names]
    )


def item_rates(
    df: DataFrame, column: str, value: str, items: DataFrame, target: float, item: str = "item"
) -> DataFrame:
    """Mean of (value - target) / target over the rows with the item."""
    rate = F.avg((number(df, value) - F.lit(float(target))) / F.lit(float(target)))
    return per_item(df, column, {f"{value}_distro": rate}, items, item)


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float, keys: Sequence[str] = ()) -> DataFrame:
    """Share of all rows in each of ``bins`` equal bins on [low, high]; the last bin is closed.

    Values outside count in the denominator only. Bins without rows are not listed.
    """
    value = number(df, column)
    place = F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(bins)), F.lit(bins - 1))
    inside = (value >= F.lit(low)) & (value <= F.lit(high))
    marked = df.select(*[q(k) for k in keys], F.when(inside, place).cast("int").alias("bin"))
    counts = marked.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return (
        counts.withColumn("p", F.col("n") / F.sum("n").over(whole))
        .where(F.col("bin").isNotNull())
        .select(*[q(k) for k in keys], "bin", "n", "p")
    )


def search_range(df: DataFrame, column: str) -> DataFrame:
    """Where to look for values of ``column``: its mean plus or minus 1.5 times mean and spread."""
    value = number(df, column)
    facts = df.agg(F.abs(F.avg(value)).alias("m"), F.abs(F.stddev_pop(value)).alias("v"))
    reach = (F.col("v") + F.col("m")) * 1.5
    return facts.select("m", "v", (F.col("m") - reach).alias("low"), (F.col("m") + reach).alias("high"))


def grouped_importance(
    importances: DataFrame, groups: Mapping[str, Sequence[str]] | None, feature: str = "feature",
    value: str = "importance", absolute: bool = True,
) -> DataFrame:
    """Importances summed by feature group; features without a group stand alone; ascending.

    As in a name-keyed table, only members of a group are taken by their size.
    """
    pairs = [(f, g) for g, fs in (groups or {}).items() for f in fs]
    table = importances.sparkSession.createDataFrame(pairs, f"{feature} string, _group string")
    size = F.when(F.col("_group").isNotNull() & F.lit(absolute), F.abs(value)).otherwise(F.col(value))
    return (
        importances.join(F.broadcast(table), feature, "left")
        .groupBy(F.coalesce("_group", feature).alias(feature))
        .agg(F.sum(size).alias(value))
        .orderBy(value, feature)
    )
