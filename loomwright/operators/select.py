"""Projections, predicates, casts and row selection."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import mathops, text
from loomwright.plans.columns import NUMBERS, containing, known, q, type_of, with_all
from loomwright.plans.operator import Operator
from loomwright.plans.ordered import ranked_values


@dataclass(frozen=True)
class Rename(Operator):
    """Rename a column only when the source exists and the target does not."""

    aliases: Mapping[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        wanted = {a: b for a, b in self.aliases.items() if a in df.columns and b not in df.columns}
        return df.withColumnsRenamed(wanted)


@dataclass(frozen=True)
class Cast(Operator):
    """Best-effort cast: what cannot be read as the declared type becomes NULL."""

    types: Mapping[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: q(c).try_cast(t) for c, t in self.types.items() if c in df.columns})

    def lost(self, df: DataFrame) -> DataFrame:
        """How many filled cells each cast turns into NULL."""
        there = [c for c in self.types if c in df.columns]
        counts = df.agg(*[
            F.count_if(q(c).isNotNull() & q(c).try_cast(self.types[c]).isNull()).alias(c) for c in there
        ])
        return counts.unpivot([], there, "column", "lost") if there else counts


@dataclass(frozen=True)
class MissingFeatures(Operator):
    """Feature columns that are absent become 0."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: F.lit(0.0) for c in self.columns if c not in df.columns})


@dataclass(frozen=True)
class FillMissing(Operator):
    """NULL and NaN become ``value`` in numbers and false in flags; text stays NULL."""

    value: float = 0
    columns: tuple[str, ...] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for f in df.schema.fields:
            if self.columns is not None and f.name not in self.columns:
                continue
            if isinstance(f.dataType, NUMBERS):
                new[f.name] = F.coalesce(known(q(f.name), f.dataType), F.lit(self.value).cast(f.dataType))
            elif isinstance(f.dataType, T.BooleanType):
                new[f.name] = F.coalesce(q(f.name), F.lit(False))
        return with_all(df, new)


@dataclass(frozen=True)
class Finite(Operator):
    """NaN becomes 0, +infinity the largest half-precision number."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: mathops.finite(q(c).cast("double")) for c in self.columns})


@dataclass(frozen=True)
class SetByName(Operator):
    """Every column whose name contains a key is overwritten with that key's constant."""

    defaults: Mapping[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: F.lit(v) for part, v in self.defaults.items() for c in containing(df, part)})


@dataclass(frozen=True)
class FillEmptyGroup(Operator):
    """Where a group of flags is all off, switch all of them on."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        total = reduce(operator.add, [F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in self.columns])
        return with_all(df, {
            c: F.when(total == 0, F.lit(1).cast(type_of(df, c))).otherwise(q(c)) for c in self.columns
        })


@dataclass(frozen=True)
class FillEmptyGroups(Operator):
    """``FillEmptyGroup`` for every group of columns that share a part of their name."""

    parts: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        for part in self.parts:
            group = containing(df, part)
            if group:
                df = FillEmptyGroup(tuple(group)).transform(df)
        return df


def route(criteria: Mapping[str, object]) -> Column:
    """True where any criterion column equals its constant."""
    hits = [F.coalesce(q(c) == F.lit(v), F.lit(False)) for c, v in criteria.items()]
    return reduce(operator.or_, hits, F.lit(False))


def holds_item(df: DataFrame, column: str, item: object) -> Column:
    """True where the list column contains the item; false for NULL and for non-list columns."""
    if not isinstance(type_of(df, column), T.ArrayType):
        return F.lit(False)
    return F.coalesce(F.array_contains(q(column), F.lit(item)), F.lit(False))


@dataclass(frozen=True)
class OutlierRule(Operator):
    """Flag values above a multiple of the sample spread; at most half of the rows may be flagged.

    The multiple starts at ``threshold`` and grows in steps of 0.1 until at most half are flagged.
    Only the median decides how many steps that takes, so they are computed, not tried.
    """

    column: str
    threshold: float = 4.0
    flag: str = "outlier"
    limit: float | None = None

    whole_table = True

    def fit(self, df: DataFrame) -> OutlierRule:
        spread = df.agg(F.stddev_samp(known(q(self.column), type_of(df, self.column)))).first()[0]
        if not spread:
            return OutlierRule(self.column, self.threshold, self.flag, math.inf)
        # with n rows, at most n/2 exceed the limit exactly when the row of rank ceil(n/2)-1 does not
        _, found = ranked_values(df, [self.column], lambda n: [-(-n // 2) - 1], [0.5])[self.column]
        median_row = next(iter(found.values()))
        steps = max(0, math.ceil((median_row / spread - self.threshold) / 0.1 - 1e-9))
        return OutlierRule(self.column, self.threshold, self.flag, (self.threshold + 0.1 * steps) * spread)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.flag, F.coalesce(q(self.column) > F.lit(self.limit), F.lit(False)))

    def drop_flagged(self, df: DataFrame) -> DataFrame:
        return self.transform(df).where(~q(self.flag)).drop(self.flag)


@dataclass(frozen=True)
class PlayableVideos(Operator):
    """Take names of re-encoded videos out of list columns."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {
            c: text.playable_videos(q(c)) for c in self.columns if type_of(df, c) == T.ArrayType(T.StringType())
        })


def drop_superseded(df: DataFrame, new: Sequence[str], suffix: str = "_dropme") -> DataFrame:
    """Old columns that are about to be appended again, and leftovers of a merge."""
    return df.drop(*[c for c in df.columns if c in set(new) or c.endswith(suffix)])


def only_ids(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def except_ids(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def random_split(df: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    first, second = df.randomSplit([train, 1 - train], seed)
    return first, second


def hash_share(keys: Sequence[str], seed: int = 42) -> Column:
    """A number in [0, 1) that depends only on the key values."""
    return F.pmod(F.xxhash64(*[q(k) for k in keys], F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def mark_split(df: DataFrame, keys: Sequence[str], train: float = 0.8, seed: int = 42, name: str = "split") -> DataFrame:
    """Stable split: the same key is always on the same side, also after a retry or a new load."""
    return df.withColumn(name, F.when(hash_share(keys, seed) < train, "train").otherwise("valid"))


@dataclass(frozen=True)
class KeepWhere(Operator):
    """Rows for which a predicate builder holds (outlier functions and the like)."""

    predicate: Callable[[DataFrame], Column]
    columns: tuple[str, ...] = field(default=())

    def transform(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df))
