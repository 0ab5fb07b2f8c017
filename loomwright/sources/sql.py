"""SQL text, tables over JDBC, and query results as files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_text(spark: SparkSession, path: str) -> str:
    """Query text from any file system Spark can read."""
    return spark.read.option("wholetext", True).text(path).first()[0]


def is_file(query: str) -> bool:
    return query.strip().endswith(".sql")


def run(
    spark: SparkSession, query: str, condition: str | None = None, args: Mapping[str, object] | None = None
) -> DataFrame:
    """A query given as text or as a ``.sql`` file, over catalog tables and views.

    Values are passed as parameter markers (``:name``; names of tables and columns through
    ``IDENTIFIER(:name)``), never pasted into the text. ``condition`` is appended.
    """
    text = read_text(spark, query) if is_file(query) else query
    if condition:
        text = f"{text.rstrip().rstrip(';')}\n{condition}"
    return spark.sql(text, args=dict(args or {}))


def read_jdbc(
    spark: SparkSession, url: str, query: str, condition: str | None = None, **options: str
) -> DataFrame:
    """A SELECT run by a database."""
    text = f"{query.rstrip().rstrip(';')} {condition}" if condition else query
    return spark.read.format("jdbc").option("url", url).option("query", text).options(**options).load()


def read_jdbc_split(
    spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column at once."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=dict(options)
    )


def to_csv(df: DataFrame, path: str) -> str:
    """Query result as a folder of CSV files."""
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path
