"""Where queries and their SQL twins are listed."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ("expressions", "groups", "lists", "statistics", "learning", "storage")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def register(function: Query) -> Query:
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is listed twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"loomwright.catalog.{module}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Double rounded half away from zero, as SQL engines do; minus zero becomes zero.

    Plain arithmetic stays in generated code, whereas ``round`` goes through decimals row by row.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    unit = F.lit(float(10**digits))
    return F.signum(value) * F.floor(F.abs(value) * unit + F.lit(0.5)) / unit + F.lit(0.0)


def text_list(column: Column | str) -> Column:
    """A list as one text, gaps as ``~``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), "|", "~")
