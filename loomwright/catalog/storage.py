"""Sources, sinks, stored artifacts, run registry and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from loomwright.catalog.groups import LARGE_CODED, large_coded
from loomwright.catalog.registry import query, rounded, table, text_list
from loomwright.operators import features
from loomwright.operators.encode import Codes, OneHot
from loomwright.operators.lookup import DecodeIds, DecodeRegions
from loomwright.operators.models import GroupedRegressor, LinearRegressor, SparkRegressor
from loomwright.operators.search import best_run, leaderboard
from loomwright.plans.operator import Chain
from loomwright.session import scratch_path
from loomwright.sources import artifacts, files
from loomwright.sources import sql as sqlsource
from loomwright.streaming import score

ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"


def orders_as_csv(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return sqlsource.to_csv(rows, scratch_path(spark, "orders-csv"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def csv_folder(spark, sf):
    return files.read_csv(spark, orders_as_csv(spark, sf), ORDER_SCHEMA)


@query("SELECT o_custkey, o_totalprice * 2 AS o_totalprice FROM orders")
def features_and_labels_from_csv(spark, sf):
    return files.features_and_labels(
        spark, orders_as_csv(spark, sf), ["o_custkey", "not_there"], ["o_totalprice"], ORDER_SCHEMA,
        processor=lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") * 2), shuffle_seed=7)


@query("""
SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0) AS o_totalprice
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def numeric_frame(spark, sf):
    rows = table(spark, sf, "orders").withColumn(
        "o_totalprice", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(F.lit(float("nan"))))
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return files.numeric_frame(rows, ["o_custkey"], ["o_totalprice"], ids, ["o_custkey"])


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'P' GROUP BY 1 ORDER BY 1")
def parameterised_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("order_rows")
    text = "SELECT o_orderpriority, count(*) AS n FROM IDENTIFIER(:source) WHERE o_totalprice > :low"
    return sqlsource.run(spark, text, "AND o_orderstatus <> :status GROUP BY 1 ORDER BY 1",
                         {"source": "order_rows", "low": 200000, "status": "P"})


@query("SELECT r_name, CAST(count(*) AS BIGINT) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def query_result_as_csv(spark, sf):
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"{name}_rows")
    result = sqlsource.run(
        spark, "SELECT r_name, count(*) AS nations FROM nation_rows JOIN region_rows ON n_regionkey = r_regionkey GROUP BY 1")
    path = sqlsource.to_csv(result, scratch_path(spark, "result"))
    return files.read_csv(spark, path, "r_name string, nations bigint")


@query()
def file_inventory(spark, sf):
    listed = files.list_files(spark, sf, r"\.parquet$")
    name = files.path_parts(F.col("path"))[2]
    return listed.select(name.alias("name"), "length")


@query("""
SELECT page_id, regexp_extract(regexp_replace(url, '^[^:]*:/*', ''), '^([^/]*)', 1) AS bucket,
       regexp_extract(regexp_replace(url, '^[^:]*:/*', ''), '^[^/]*/(.*)/[^/]*$', 1) AS folder,
       regexp_extract(regexp_replace(url, '^[^:]*:/*', ''), '([^/]*)$', 1) AS name FROM pages""")
def path_parts(spark, sf):
    parts = files.path_parts(F.col("url"))
    return table(spark, sf, "pages").select("page_id", *[p.alias(n) for p, n in zip(parts, ("bucket", "folder", "name"))])


@query("""
SELECT o_orderkey, dayname(o_orderdate) AS weekday, round(ln(1 + o_totalprice), 6) AS o_totalprice,
       o_orderpriority = '1-URGENT' AS "o_orderpriority_1-URGENT", o_orderpriority = '2-HIGH' AS "o_orderpriority_2-HIGH",
       o_orderpriority = '3-MEDIUM' AS "o_orderpriority_3-MEDIUM", o_orderpriority = '4-NOT SPECIFIED' AS "o_orderpriority_4-NOT SPECIFIED",
       o_orderpriority = '5-LOW' AS "o_orderpriority_5-LOW" FROM orders""")
def stored_chain(spark, sf):
    """A fitted chain, stored, loaded and applied."""
    rows = table(spark, sf, "orders")
    chain = Chain((features.WeekdayName(("o_orderdate",)), features.SignedLog(("o_totalprice",)), OneHot(("o_orderpriority",))))
    path = artifacts.save(spark, chain.fit(rows), scratch_path(spark, "chain"))
    done = artifacts.load(spark, path)(rows)
    return done.drop("o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority").withColumn("o_totalprice", rounded("o_totalprice"))


@query("""
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def stored_group_models(spark, sf):
    model = GroupedRegressor(("l_quantity",), ("l_extendedprice",), "l_returnflag").fit(table(spark, sf, "lineitem"))
    loaded = artifacts.load(spark, artifacts.save(spark, model, scratch_path(spark, "models")))
    slope = F.get(F.get("weights", F.lit(0)), F.lit(0))
    return loaded.table.select("l_returnflag", rounded(slope, 4).alias("slope"), "n")


def stored_runs(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("split", F.when(F.col("l_linestatus") == "F", "train").otherwise("valid"))
    path = scratch_path(spark, "runs")
    first, _ = leaderboard(rows, [LinearRegressor((c,), ("l_extendedprice",)) for c in ("l_tax", "l_quantity")], "split")
    artifacts.append_runs(first, path)
    second, _ = leaderboard(
        rows, [LinearRegressor(("l_discount",), ("l_extendedprice", "l_tax"))], "split", first_run=2)
    artifacts.append_runs(second, path)
    return spark.read.parquet(path)


RUNS = """
WITH t AS (SELECT *, l_linestatus = 'F' AS tr FROM lineitem),
     f AS (SELECT regr_r2(l_extendedprice, l_tax) FILTER (tr) AS a, regr_r2(l_extendedprice, l_quantity) FILTER (tr) AS b,
                  (regr_r2(l_extendedprice, l_discount) FILTER (tr) + regr_r2(l_tax, l_discount) FILTER (tr)) / 2 AS c FROM t),
     r AS (SELECT 0 AS run, a AS s, ['l_extendedprice'] AS targets FROM f UNION ALL SELECT 1, b, ['l_extendedprice'] FROM f
           UNION ALL SELECT 2, c, ['l_extendedprice', 'l_tax'] FROM f)
"""


@query(RUNS + """
SELECT CAST(max(run) AS INTEGER) AS max_run, CAST(arg_max(run, s) AS INTEGER) AS best_run, CAST(arg_min(run, s) AS INTEGER) AS worst_run,
       CAST(count(*) AS BIGINT) AS runs, round(max(s), 6) AS best_score FROM r""")
def run_registry(spark, sf):
    runs = stored_runs(spark, sf)
    best = best_run(runs, "train_score").select(F.col("run").alias("best_run"), rounded("train_score").alias("best_score"))
    worst = best_run(runs, "train_score", maximize=False).select(F.col("run").alias("worst_run"))
    counts = runs.agg(F.count(F.lit(1)).alias("runs"))
    return artifacts.max_run(runs).join(best).join(worst).join(counts)


@query(RUNS + "SELECT CAST(run AS INTEGER) AS run, array_to_string(list_sort(targets), '|') AS targets FROM r")
def targets_of_runs(spark, sf):
    return artifacts.run_targets(stored_runs(spark, sf)).select("run", F.array_join("targets", "|").alias("targets"))


def streamed(spark, stream, operator):
    path, marks = scratch_path(spark, "streamed"), scratch_path(spark, "stream-marks")
    written = score.write_available(score.score_stream(stream, operator), path, marks)
    written.awaitTermination()
    return spark.read.parquet(path)


@query("""
SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS o_totalprice, o_orderpriority = '1-URGENT' AS "o_orderpriority_1-URGENT" FROM orders""")
def csv_stream(spark, sf):
    """CSV files of a folder as a stream through a fitted chain."""
    chain = Chain((features.SignedLog(("o_totalprice",)), OneHot(("o_orderpriority",), {"o_orderpriority": ["1-URGENT"]})))
    stream = score.csv_stream(spark, orders_as_csv(spark, sf), ORDER_SCHEMA, files_per_batch=2)
    done = streamed(spark, stream, chain)
    return done.select("o_orderkey", rounded("o_totalprice").alias("o_totalprice"), "`o_orderpriority_1-URGENT`")


@query("""
WITH f AS (SELECT regr_slope(value, user_id) AS a, regr_intercept(value, user_id) AS b FROM events)
SELECT event_id, dayname(ts) AS weekday, round(a * user_id + b, 6) AS pred_value FROM events, f""")
def scored_stream(spark, sf):
    """A model fitted on the stored table scores the same table as it streams in."""
    rows = table(spark, sf, "events")
    chain = Chain((features.WeekdayName(("ts",)), LinearRegressor(("user_id",), ("value",)))).fit(rows)
    stream = score.table_stream(spark, sf, rows.schema, "events.parquet")
    done = streamed(spark, stream, chain)
    return done.select("event_id", "weekday", rounded("pred_value").alias("pred_value"))


def streamed_batches(spark, stream, operator):
    path, marks = scratch_path(spark, "streamed"), scratch_path(spark, "stream-marks")
    score.write_batches(stream, operator, path, marks).awaitTermination()
    return spark.read.parquet(path)


@query(LARGE_CODED)
def streamed_region_names(spark, sf):
    """Lists on a stream, decoded by a reference table that is joined batch by batch."""
    rows, reference = large_coded(spark, sf)
    path = scratch_path(spark, "coded")
    rows.repartition(3).write.parquet(path)
    stream = score.table_stream(spark, path, rows.schema, files_per_batch=2)
    done = streamed_batches(spark, stream, DecodeRegions("_region", reference))
    return done.select("o_orderkey", text_list("x_region_name").alias("x_region_name"))


@query("""
WITH u AS (SELECT DISTINCT o_orderkey, unnest([o_custkey, o_custkey * 7]) AS id FROM orders)
SELECT o_orderkey, string_agg(c_name, '|' ORDER BY id) AS ids_name FROM u JOIN customer ON c_custkey = id GROUP BY 1""")
def streamed_id_names(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") * 7).alias("ids"))
    path = scratch_path(spark, "coded")
    rows.repartition(3).write.parquet(path)
    reference = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    done = streamed_batches(spark, score.table_stream(spark, path, rows.schema, files_per_batch=2), DecodeIds("ids", reference))
    return done.select("o_orderkey", text_list("ids_name").alias("ids_name"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS o_custkey_index FROM orders")
def streamed_codes(spark, sf):
    """A dictionary made from the stored table codes the stream, in the stream's own plan."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    codes = Codes(("o_custkey",)).fit(rows)
    path = scratch_path(spark, "orders")
    rows.write.parquet(path)
    done = streamed(spark, score.table_stream(spark, path, rows.schema), codes)
    return done.select("o_orderkey", "o_custkey_index")


@query("""
WITH m AS (SELECT l_linenumber, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, round(p, 2) AS pred_l_extendedprice, l_shipdate::DATE = DATE '1995-03-01' AS "day_1995-03-01"
FROM lineitem JOIN m USING (l_linenumber)""")
def stored_tree_model(spark, sf):
    """A chain with a Spark ML model and flags of dates, stored and read again."""
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date"))
    flags = OneHot(("day",), {"day": [datetime.date(1995, 3, 1)]})
    tree = SparkRegressor(("l_linenumber",), ("l_extendedprice",), build=lambda: DecisionTreeRegressor(maxDepth=7, seed=42))
    path = artifacts.save(spark, Chain((flags, tree)).fit(rows), scratch_path(spark, "stored-tree"))
    done = artifacts.load(spark, path)(rows)
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount",
                       rounded("pred_l_extendedprice", 2).alias("pred_l_extendedprice"), "`day_1995-03-01`")
