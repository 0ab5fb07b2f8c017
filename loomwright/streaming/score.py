"""Fitted operators on streams: row-wise ones in the stream's own plan, others batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomwright.plans.columns import nan_to_null
from loomwright.plans.operator import Operator


def csv_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1_000) -> DataFrame:
    """New CSV files under a folder, as they come."""
    reader = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch)
    return nan_to_null(reader.option("pathGlobFilter", "*.csv").csv(path))


def table_stream(
    spark: SparkSession, path: str, schema: T.StructType, name_pattern: str = "*.parquet", files_per_batch: int = 1_000
) -> DataFrame:
    """New parquet files under a folder, as they come."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return nan_to_null(reader.option("pathGlobFilter", name_pattern).parquet(path))


def score_stream(stream: DataFrame, operator: Operator) -> DataFrame:
    """The operator on a stream; operators that need the whole table raise."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return operator(stream)


def write_available(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that is there now as parquet, then stop; a restart goes on where it stopped."""
    return (
        scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def write_batches(stream: DataFrame, operator: Operator, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that is there now, transformed batch by batch, as parquet; then stop.

    A batch is a table like any other, so look-ups that take lists apart and join large tables work here; what an operator
    says of a whole table (first rows, groups) it says of the batch. A batch has a folder of its own, ``batch=<n>``, which
    is written anew when the batch is repeated after a failure, so every row is written once.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream")

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
