"""Readers, splits, inventories and streams."""

import json

import pytest
from pyspark.sql import functions as F

from loomwright.operators.encode import OneHot
from loomwright.operators.features import SignedLog
from loomwright.operators.select import KeepWhere, mark_split, random_split
from loomwright.plans.operator import Chain
from loomwright.session import scratch_path
from loomwright.sources import artifacts, files, sql
from loomwright.streaming import score


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch_path(spark, "csv")
    rows = spark.range(400).select(
        "id", *[(F.col("id") % 3 + 100.5 + k).alias(f"p_{k}") for k in range(4)], *[F.lit(float(k)).alias(f"v_{k}") for k in range(4, 14)])
    rows.repartition(4, "id").write.option("header", True).csv(f"{path}/deep/er")
    return path


TYPES = {"id": "bigint", **{f"p_{k}": "double" for k in range(4)}, **{f"v_{k}": "double" for k in range(4, 14)}}


def test_declared_types_of_a_folder(spark, folder):
    schema = files.schema_from(json.loads(json.dumps(TYPES)))
    rows = files.read_csv(spark, f"{folder}/deep/er", schema)
    assert rows.schema == schema and rows.count() == 400
    assert dict(files.read_csv(spark, f"{folder}/deep/er").dtypes)["p_0"] == "double"


def test_features_and_labels_have_the_asked_width(spark, folder):
    rows = files.features_and_labels(spark, folder, ["p_0", "p_1"], ["v_4"], files.schema_from(TYPES), shuffle_seed=3)
    assert rows.columns == ["p_0", "p_1", "v_4"] and rows.count() == 400
    assert files.numeric_frame(rows, ["p_0"], ["v_4"]).columns == ["p_0", "v_4"]


def test_shuffle_depends_on_seed_only(spark):
    rows = spark.range(50)
    order = lambda df, seed: [r["id"] for r in files.shuffled(df, ["id"], seed).collect()]
    assert order(rows, 1) == order(rows.repartition(7), 1) != order(rows, 2)


def test_validation_head_and_rest(spark):
    valid, rest = files.head_and_rest(spark.range(100), 10, ["id"])
    assert sorted(r["id"] for r in valid.collect()) == list(range(10)) and rest.count() == 90


def test_splits(spark):
    rows = spark.range(5000)
    train, valid = random_split(rows)
    assert train.count() + valid.count() == 5000
    one = {r["id"]: r["split"] for r in mark_split(rows, ["id"]).collect()}
    two = {r["id"]: r["split"] for r in mark_split(rows.repartition(9), ["id"]).collect()}
    assert one == two and abs(sum(v == "train" for v in one.values()) / 5000 - 0.8) < 0.03


def test_cleaned_and_kept(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (2.0,)], "x double")
    assert [r["x"] for r in files.cleaned(rows, ["x"]).collect()] == [0.0, 0.0, 65504.0, 2.0]
    assert KeepWhere(lambda df: F.col("x") == 2.0)(rows).count() == 1


def test_inventory(spark, folder):
    listed = files.list_files(spark, folder, r"\.csv$")
    sizes = files.sizes_by_folder(listed).first()
    assert sizes["files"] == listed.count() == 4 and sizes["bytes"] > 0
    parts = files.path_parts(F.lit("s3://bucket/some/dir/key.pkl"))
    assert tuple(spark.range(1).select(*parts).first()) == ("bucket", "some/dir", "key.pkl")


def test_run_numbers_from_names(spark):
    rows = spark.createDataFrame([("s3://b/run/cb_run_7.pkl",), ("s3://b/run/cb_run_12.pkl",), ("s3://b/other.txt",)], "path string")
    runs = rows.select(artifacts.run_from_name(F.col("path")).alias("run"))
    assert artifacts.max_run(runs).first()["max_run"] == 12


def test_query_from_a_file_with_markers(spark):
    path = scratch_path(spark, "query") + ".sql"
    spark.createDataFrame([("SELECT count(*) AS n FROM IDENTIFIER(:t) WHERE id < :top",)], "value string").coalesce(1).write.text(path)
    spark.range(100).createOrReplaceTempView("numbers_to_count")
    assert sql.run(spark, path, args={"t": "numbers_to_count", "top": 7}).first()["n"] == 7


def test_stream_goes_on_where_it_stopped(spark):
    source, target, marks = (scratch_path(spark, n) for n in ("in", "out", "marks"))
    chain = Chain((SignedLog(("x",)), OneHot(("k",), {"k": ["a"]})))
    expected = 0
    for part in range(2):
        rows = spark.createDataFrame([("a", float(part)), ("b", -1.0)], "k string, x double")
        rows.coalesce(1).write.mode("append").option("header", True).csv(source)
        stream = score.csv_stream(spark, source, "k string, x double")
        score.write_available(score.score_stream(stream, chain), target, marks).awaitTermination()
        expected += 2
        done = spark.read.parquet(target)
        assert done.count() == expected and done.columns == ["k", "x", "k_a"]
    with pytest.raises(ValueError):
        score.score_stream(done, chain)
