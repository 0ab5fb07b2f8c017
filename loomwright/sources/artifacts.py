"""Fitted operators as JSON plus parquet tables, and run leaderboards."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import json
from collections.abc import Mapping

from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.plans.operator import Operator


def _known_kinds() -> dict[str, type]:
    import importlib

    for module in ("aggregate", "curves", "decompose", "embed", "encode", "features", "lookup", "models", "scale",
                   "scoring", "select", "spine"):
        importlib.import_module(f"loomwright.operators.{module}")
    return Operator.kinds


@dataclasses.dataclass
class Parts:
    """What a stored operator keeps beside its JSON text: tables and Spark ML models."""

    tables: list[DataFrame] = dataclasses.field(default_factory=list)
    models: list = dataclasses.field(default_factory=list)


def _pack(value: object, parts: Parts) -> object:
    if isinstance(value, Operator):
        left_out = value.needed_to_fit if getattr(value, "fitted", None) else ()
        body = {f.name: None if f.name in left_out else _pack(getattr(value, f.name), parts) for f in dataclasses.fields(value)}
        return {"operator": type(value).__name__, "fields": body}
    if isinstance(value, DataFrame):
        parts.tables.append(value)
        return {"table": len(parts.tables) - 1}
    if isinstance(value, Transformer):
        parts.models.append(value)
        return {"model": len(parts.models) - 1}
    if isinstance(value, Mapping):
        return {"pairs": [[_pack(k, parts), _pack(v, parts)] for k, v in value.items()]}
    if isinstance(value, (tuple, list)):
        return {"tuple" if isinstance(value, tuple) else "list": [_pack(v, parts) for v in value]}
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    for name, (kind, text, _) in SCALARS.items():
        if type(value) is kind:
            return {name: text(value)}
    raise TypeError(f"{type(value).__name__} is code, not state, and cannot be stored")


#: values that JSON has no form for: their type, as text, and back
SCALARS = {
    "date": (datetime.date, datetime.date.isoformat, datetime.date.fromisoformat),
    "moment": (datetime.datetime, datetime.datetime.isoformat, datetime.datetime.fromisoformat),
    "span": (datetime.timedelta, lambda v: [v.days, v.seconds, v.microseconds], lambda v: datetime.timedelta(*v)),
    "decimal": (decimal.Decimal, str, decimal.Decimal),
    "bytes": (bytes, bytes.hex, bytes.fromhex),
    "bytearray": (bytearray, bytearray.hex, bytearray.fromhex),
}


def _unpack(value: object, parts: Parts) -> object:
    if not isinstance(value, dict):
        return value
    (kind, body), *rest = value.items()
    if kind == "operator":
        fields = {k: _unpack(v, parts) for k, v in value["fields"].items()}
        return _known_kinds()[body](**fields)
    if kind == "table":
        return parts.tables[body]
    if kind == "model":
        return parts.models[body]
    if kind == "pairs":
        return {_unpack(k, parts): _unpack(v, parts) for k, v in body}
    if kind in SCALARS:
        return SCALARS[kind][2](body)
    return (tuple if kind == "tuple" else list)(_unpack(v, parts) for v in body)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def free_path(spark: SparkSession, path: str) -> str:
    """The path itself, or with ``_n`` appended when it is taken."""
    name, n = path, 0
    while exists(spark, name):
        n += 1
        name = f"{path}_{n}"
    return name


def save(spark: SparkSession, operator: Operator, path: str) -> str:
    """Store an operator with its tables and fitted Spark ML models; returns the path used.

    What an operator needs for fitting only (``needed_to_fit``) is code and is left out once it is fitted.
    """
    path = free_path(spark, path)
    parts = Parts()
    text = json.dumps(_pack(operator, parts))
    for i, table in enumerate(parts.tables):
        table.write.parquet(f"{path}/table_{i}")
    for i, model in enumerate(parts.models):
        model.write().save(f"{path}/model_{i}")
    row = [(text, len(parts.tables), len(parts.models))]
    spark.createDataFrame(row, "state string, tables int, models int").write.parquet(f"{path}/state")
    return path


def load(spark: SparkSession, path: str) -> Operator:
    row = spark.read.parquet(f"{path}/state").first()
    tables = [spark.read.parquet(f"{path}/table_{i}") for i in range(row["tables"])]
    models = [DefaultParamsReader.loadParamsInstance(f"{path}/model_{i}", spark) for i in range(row["models"])]
    return _unpack(json.loads(row["state"]), Parts(tables, models))


def append_runs(board: DataFrame, path: str) -> str:
    """Add leaderboard rows to the stored runs."""
    board.write.mode("append").parquet(path)
    return path


def max_run(runs: DataFrame, run: str = "run") -> DataFrame:
    return runs.agg(F.coalesce(F.max(run), F.lit(0)).alias("max_run"))


def run_from_name(path: Column) -> Column:
    """Run number at the end of a stored file's name."""
    return F.regexp_extract(path, r"_(\d+)\.[^.]*$", 1).try_cast("int")


def run_targets(runs: DataFrame, run: str = "run", targets: str = "targets") -> DataFrame:
    """All targets of every run, sorted."""
    return runs.select(run, F.explode(targets).alias("target")).groupBy(run).agg(
        F.array_sort(F.collect_set("target")).alias("targets")
    )
