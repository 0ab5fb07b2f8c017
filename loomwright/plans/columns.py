"""Small helpers to build wide projections in one ``select``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
NUMBERS = (*FLOATS, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def q(name: str) -> Column:
    """Column by exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def with_all(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """Replace or add columns in one projection; kept order, new names last."""
    kept = [new[c].alias(c) if c in new else q(c) for c in df.columns]
    added = [expr.alias(c) for c, expr in new.items() if c not in df.columns]
    return df.select(*kept, *added)


def containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def known(column: Column, data_type: T.DataType) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.nanvl(column, F.lit(None).cast(data_type)) if isinstance(data_type, FLOATS) else column


def number(df: DataFrame, name: str) -> Column:
    """A column as double with NaN as NULL."""
    return known(q(name), type_of(df, name)).cast("double")


def filled(df: DataFrame, name: str, value: float = 0.0) -> Column:
    return F.coalesce(number(df, name), F.lit(value))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Source boundary rule: a missing float is always NULL."""
    floats = {f.name: known(q(f.name), f.dataType) for f in df.schema.fields if isinstance(f.dataType, FLOATS)}
    return with_all(df, floats) if floats else df


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value: Column) -> Column:
    """The same value, which keeps its projection out of whole-stage code.

    There all columns of a wide projection are one method, and the JVM never compiles methods above 8000 bytes. A projection
    of its own is split into short ones.
    """
    return let(value, lambda v: v)


def lit_array(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
