"""CSV folders, feature/label frames, validation rows, file inventories."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.select import FillMissing, Finite
from loomwright.plans.columns import filled, nan_to_null, q


def schema_from(types: Mapping[str, str]) -> T.StructType:
    """Declared column types (as in a JSON file of names and types) as a schema."""
    return T.StructType([T.StructField(c, T._parse_datatype_string(t)) for c, t in types.items()])


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, recursive: bool = False
) -> DataFrame:
    """One CSV file, or all CSV files under a path, as one scan; missing numbers are NULL."""
    reader = spark.read.option("header", True)
    if not path.endswith(".csv"):
        reader = reader.option("pathGlobFilter", "*.csv")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def features_and_labels(
    spark: SparkSession, path: str, features: Sequence[str], labels: Sequence[str],
    schema: T.StructType | str | None = None, processor: Callable[[DataFrame], DataFrame] | None = None,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """Feature and label columns of all CSV files under a path, optionally processed and shuffled."""
    rows = read_csv(spark, path, schema, recursive=True)
    if processor is not None:
        rows = rows.transform(processor)
    wanted = [c for c in [*features, *labels] if c in rows.columns]
    rows = rows.select(*[q(c) for c in wanted])
    return shuffled(rows, wanted, shuffle_seed) if shuffle_seed is not None else rows


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in an order that depends on the key values and the seed only."""
    return df.orderBy(F.xxhash64(*[q(k) for k in keys], F.lit(seed)), *[q(k) for k in keys])


def head(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(*[q(k) for k in keys]).limit(n)


def head_and_rest(df: DataFrame, n: int, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first n rows by a unique key for validation, the others for training."""
    valid = head(df, n, keys)
    return valid, df.join(valid.select(*keys), list(keys), "left_anti")


def numeric_frame(
    df: DataFrame, features: Sequence[str], labels: Sequence[str], ids: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Features and labels as doubles with gaps as 0; optionally only the rows of an id table."""
    if ids is not None:
        df = df.join(ids.select(*keys).distinct(), list(keys), "left_semi")
    return df.select(*[filled(df, c).alias(c) for c in [*features, *labels]])


def cleaned(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return Finite(tuple(columns)).transform(FillMissing(columns=tuple(columns)).transform(df))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Bucket, folder and file name of ``scheme://bucket/folder/.../name``."""
    plain = F.regexp_replace(path, F.lit(r"^[^:]*:/*"), F.lit(""))
    return (
        F.regexp_extract(plain, r"^([^/]*)", 1),
        F.regexp_extract(plain, r"^[^/]*/(.*)/[^/]*$", 1),
        F.regexp_extract(plain, r"([^/]*)$", 1),
    )


def list_files(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """Files under a path whose name matches a regular expression; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = found.select("path", "length", "modificationTime")
    return listed.where(F.col("path").rlike(pattern)) if pattern else listed


def sizes_by_folder(files: DataFrame) -> DataFrame:
    bucket, folder, _ = path_parts(F.col("path"))
    return files.groupBy(bucket.alias("bucket"), folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
