"""Flags and codes for values and list elements."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.aggregate import distinct_items, distinct_values
from loomwright.plans.columns import known, q, type_of, with_all
from loomwright.plans.joins import salted_join
from loomwright.plans.operator import Operator
from loomwright.plans.ranks import ranked
from loomwright.session import stored


def is_list(df: DataFrame, column: str) -> bool:
    return isinstance(type_of(df, column), T.ArrayType)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """The distinct known values (or list elements) of a column, numbered from 0 in their order: value, index.

    Values are dealt into ranges and numbered there, so a dictionary may be of any size; it is stored.
    """
    if is_list(df, column):
        values = df.select(F.explode(F.array_distinct(q(column))).alias("value"))
    else:
        values = df.select(q(column).alias("value"))
    whole = values.select(known(F.col("value"), type_of(values, "value")).alias("value")).where("value is not null").distinct()
    return stored(ranked(whole, [], [F.col("value")], "index"), "dictionary")


def joined_codes(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """A column ``out`` with what a table (k, v) says of each value; NULL where it says nothing."""
    named = table.select(F.col("k").alias(column), F.col("v").alias("_code"))
    # a stream has no counts to slice by; its micro-batches are small
    joined = df.join(named, column, "left") if df.isStreaming else salted_join(df, named, [column], "left")
    return joined.select(*[q(c) for c in df.columns if c != out], F.col("_code").alias(out))


def joined_lists(df: DataFrame, column: str, table: DataFrame, out: str, finish=None, code=None, otherwise=None) -> DataFrame:
    """A column ``out`` with what a table (k, v) says of each list element, in the list's order.

    The list itself is the key: different lists are taken apart, looked up, put together again in their old order
    and joined back, so rows need no key and rows that repeat do no harm. ``finish`` makes the list of answers
    into the result before it is joined back. NULL lists stay NULL.
    """
    element = F.col("_element") if code is None else code(F.col("_element"))
    lists = df.where(q(column).isNotNull()).select(q(column).alias("_list")).distinct()
    items = lists.select("_list", F.posexplode("_list").alias("_pos", "_element")).withColumn("k", element)
    found = salted_join(items, table, ["k"], "left")
    value = F.col("v") if otherwise is None else otherwise(F.col("_element"), F.col("v"))
    answers = F.transform(F.array_sort(F.collect_list(F.struct("_pos", value.alias("v")))), lambda p: p["v"])
    decoded = found.groupBy(F.col("_list").alias(column)).agg(answers.alias("_decoded"))
    kind = decoded.schema["_decoded"].dataType
    if finish is not None:
        decoded = decoded.withColumn("_decoded", finish(F.col("_decoded")))
    joined = salted_join(df, decoded, [column], "left")
    nothing = F.when(q(column).isNotNull(), F.array().cast(kind))
    return joined.select(*[q(c) for c in df.columns if c != out], F.coalesce(q("_decoded"), nothing).alias(out))


@dataclass(frozen=True)
class Codes(Operator):
    """The place of a value in the sorted dictionary of its column, as a column ``<c>_index``, for dictionaries of any size.

    A list column gives ``<c>_indices``: the sorted places of its distinct elements, which is the sparse form of one flag
    per element. NULL, NaN and values that were not there when the dictionary was made give NULL, or no entry in a list.
    Without ``tables`` (value, index) the dictionaries are made by ``fit``.
    """

    columns: tuple[str, ...]
    tables: Mapping[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Codes:
        return replace(self, tables={c: self.tables[c] if c in self.tables else dictionary(df, c) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in self.tables]
        if missing:
            raise ValueError(f"fit first: dictionaries of {missing} are unknown")
        for c in self.columns:
            table = self.tables[c].select(F.col("value").alias("k"), F.col("index").alias("v"))
            if is_list(df, c):
                df = joined_lists(df, c, table, f"{c}_indices", lambda v: F.array_sort(F.array_distinct(F.array_compact(v))))
            else:
                df = joined_codes(df, c, table, f"{c}_index")
        return df


@dataclass(frozen=True)
class OneHot(Operator):
    """A flag per sorted distinct value (or given item); NULL sets none; the source stays.

    The flags are columns, so the list of items is as long as the schema; ``Codes`` is the sparse form. Only a caller's
    own ``max_items`` limits their number.
    """

    columns: tuple[str, ...]
    items: Mapping[str, list] = field(default_factory=dict)
    max_items: int | None = None

    def values(self, df: DataFrame, column: str) -> DataFrame:
        return distinct_values(df, column)

    def fit(self, df: DataFrame) -> OneHot:
        return type(self)(self.columns, {c: self.items[c] if c in self.items else self.found(df, c) for c in self.columns}, self.max_items)

    def found(self, df: DataFrame, column: str) -> list:
        values = self.values(df, column)
        items = [r[0] for r in (values if self.max_items is None else values.limit(self.max_items + 1)).collect()]
        if self.max_items is not None and len(items) > self.max_items:
            raise ValueError(f"{column} has more than {self.max_items} distinct values")
        return items

    def flag(self, df: DataFrame, column: str, item: object) -> Column:
        return q(column) == F.lit(item)

    def transform(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in self.items]
        if missing:
            raise ValueError(f"fit first: items of {missing} are unknown")
        return with_all(df, {
            f"{c}_{item}": F.coalesce(self.flag(df, c, item), F.lit(False))
            for c in self.columns for item in self.items[c]
        })


@dataclass(frozen=True)
class MultiHot(OneHot):
    """The same for list columns: a flag per distinct element. Plain cells are compared as they are."""

    def values(self, df: DataFrame, column: str) -> DataFrame:
        if is_list(df, column):
            return distinct_items(df, column)
        return distinct_values(df, column)

    def flag(self, df: DataFrame, column: str, item: object) -> Column:
        if is_list(df, column):
            return F.array_contains(q(column), F.lit(item))
        return q(column) == F.lit(item)
