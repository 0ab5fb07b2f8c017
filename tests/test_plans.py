"""Skew, order statistics, moments and lineage helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators.aggregate import GroupRows
from loomwright.operators.select import FillMissing, OutlierRule
from loomwright.operators import diverge
from loomwright.operators.aggregate import GroupValue, OncePerGroup
from loomwright.operators.features import SignedLog
from loomwright.operators.encode import Codes
from loomwright.operators.lookup import DecodeIds, DecodeRegions, MapValues
from loomwright.operators.spine import TimeGrid
from loomwright.plans.joins import salted_join
from loomwright.plans.moments import Moments, Sums, _by_aggregates, _by_matrices, array_moments
from loomwright.plans.operator import Apply, BatchOnly, Chain
from loomwright.plans.ordered import exact_quantiles, range_bin, ranged, ranked_values, running_totals
from loomwright.session import cut_lineage, shared_dir, stored


def skewed(spark, parts=7):
    """One key holds half of the rows, a fifth have no key."""
    key = F.when(F.col("id") % 10 < 5, F.lit(1)).when(F.col("id") % 10 < 7, F.lit(None)).otherwise(F.col("id") % 40)
    return spark.range(0, 4000, 1, parts).select("id", key.cast("bigint").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_sliced_join_equals_plain_join(spark, how):
    rows = skewed(spark)
    lookup = spark.range(0, 20).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    plain = sorted(map(tuple, rows.join(lookup, "k", how).select("id", "k", "v").collect()), key=str)
    sliced = salted_join(rows, lookup, ["k"], how, rows_per_task=100).select("id", "k", "v")
    assert sorted(map(tuple, sliced.collect()), key=str) == plain


def test_hot_key_is_spread_over_slices(spark):
    rows = skewed(spark)
    lookup = spark.range(0, 20).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = salted_join(rows, lookup, ["k"], "inner", rows_per_task=100)
    assert joined.where("k = 1").count() == rows.where("k = 1").count()
    plan = joined._jdf.queryExecution().toString()
    assert "_slice" in plan


def test_group_value_is_independent_of_partitions(spark):
    a = GroupValue(("k",))(skewed(spark, 1)).orderBy("id").collect()
    b = GroupValue(("k",))(skewed(spark, 7)).orderBy("id").collect()
    assert a == b


def test_once_per_group_keeps_rows_without_key(spark):
    rows = skewed(spark).withColumn("v", F.col("id").cast("double"))
    inner = SignedLog(("v",))
    done = OncePerGroup(("k",), inner, ("v",), ("id",))(rows)
    assert done.count() == rows.count()


@pytest.mark.parametrize("settings", [{}, {"listed": 40}, {"listed": 60, "cells": 64}])
def test_quantiles_are_exact(spark, settings):
    draw = np.random.default_rng(1)
    values = np.concatenate([draw.normal(size=3000), np.full(1500, 0.25), [1e9, -1e9]])
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    probs = [0, 0.1, 0.25, 0.5, 0.617, 0.9, 1]
    got = exact_quantiles(rows, ["x"], probs, **settings)["x"]
    assert got == pytest.approx(np.quantile(values, probs), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "x double"), ["x"], [0.5])["x"] == [None]


def test_range_bin_counts_edges(spark):
    edges = [0.0, 1.0, 1.5, 4.0, 9.0]
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 1.2, 4.0, 100.0)], "v double")
    got = [r[0] for r in rows.select(range_bin(F.col("v"), edges)).collect()]
    assert got == [0, 1, 2, 4, 5]


def test_quantiles_of_all_columns_take_the_same_jobs(spark):
    """The number of jobs does not grow with the columns, also where brackets are narrowed."""
    draw = np.random.default_rng(3)
    values = draw.normal(size=(4000, 6)).round(3)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in values], [f"c{k}" for k in range(6)]).repartition(4).cache()
    probs, context, jobs = [0.05, 0.5, 0.95], spark.sparkContext, []
    for columns in (["c0"], [f"c{k}" for k in range(6)]):
        context.setJobGroup(f"quantiles {len(columns)}", "count jobs")
        got = exact_quantiles(rows, columns, probs, listed=300, cells=64)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"quantiles {len(columns)}")))
        for k, c in enumerate(columns):
            assert got[c] == pytest.approx(np.quantile(values[:, k], probs), rel=1e-12)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 1


def test_values_at_ranks(spark):
    rows = spark.range(0, 1001, 1, 5).select((F.col("id") * 7919 % 1001 / 3.0).alias("x"), F.lit(None).cast("double").alias("y"))
    found = ranked_values(rows, ["x", "y"], lambda n: [0, n // 3, n - 1] if n else [], None, listed=50)
    assert found == {"x": (1001, {0: 0.0, 333: 333 / 3.0, 1000: 1000 / 3.0}), "y": (0, {})}


@pytest.mark.parametrize("size", [1000, 30, 2])
def test_running_totals_in_ranges(spark, size):
    rows = spark.createDataFrame([(float(k * k % 101), k) for k in range(101)], "v double, n int")
    per_value = rows.groupBy("v").agg(F.sum("n").alias("n"))
    got = running_totals(per_value, "v", ["n"], size).orderBy("v").collect()
    pairs = sorted((r["v"], r["n"]) for r in per_value.collect())
    assert [r["running_n"] for r in got] == list(np.cumsum([n for _, n in pairs]))
    assert [r["next_value"] for r in got] == [v for v, _ in pairs][1:] + [None]


def test_ranges_are_of_bounded_size(spark):
    """Twice as many values make twice as many ranges, not longer ones."""
    for count in (2_000, 8_000):
        sizes = [r["count"] for r in ranged(spark.range(0, count, 1, 4), "id", 500).groupBy("_range").count().collect()]
        assert sum(sizes) == count and max(sizes) <= 1_000


def test_wasserstein_against_brute_force(spark):
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=400).round(2), draw.normal(1, 2, size=300).round(2)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "value double")
    pooled = np.sort(np.concatenate([a, b]))
    cdf = lambda x: np.searchsorted(np.sort(x), pooled[:-1], side="right") / len(x)
    expected = np.sum(np.abs(cdf(a) - cdf(b)) * np.diff(pooled))
    assert diverge.wasserstein(frame(a), frame(b)).first()[0] == pytest.approx(expected)
    assert diverge.wasserstein(frame(a), frame(a)).first()[0] == 0


def test_divergence_bounds(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    one = diverge.sample(lines.where("l_returnflag = 'A'"), "l_quantity")
    two = diverge.sample(lines.where("l_returnflag = 'R'"), "l_quantity")
    js = diverge.divergences(one, two, {"js": diverge.js}).first()["js"]
    assert 0 <= js <= np.log(2)
    assert diverge.divergences(one, one, {"js": diverge.js, "kl": diverge.kl}).first()["kl"] == 0


def test_both_ways_to_moments_agree(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(1e6, 1, size=(500, 3))
    rows = spark.createDataFrame([(int(i % 4), *map(float, r)) for i, r in enumerate(x)], "g int, a double, b double, c double").repartition(5)
    for keys in ([], ["g"]):
        one = sorted(_by_aggregates(rows, ["a", "b", "c"], keys).collect(), key=str)
        two = sorted(_by_matrices(rows, ["a", "b", "c"], keys).collect(), key=str)
        for r, s in zip(one, two):
            assert r["n"] == s["n"]
            assert r["mean"] == pytest.approx(s["mean"])
            assert r["cov"] == pytest.approx(s["cov"], rel=1e-6, abs=1e-9)
    packed = rows.select(F.array("a", "b", "c").alias("v"))
    found = array_moments(packed, "v", 3)
    assert found.cov == pytest.approx(np.cov(x.T, bias=True), rel=1e-6)
    assert isinstance(found, Moments)


def test_decoding_by_map_and_by_join_agree(spark):
    table = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "id bigint, name string")
    rows = spark.createDataFrame(
        [(1, ["3", "x", "2", "1", None]), (2, []), (3, None), (4, ["9"])], "row int, ids array<string>")
    step = DecodeIds("ids", table)
    fast = step.fit(rows)(rows).orderBy("row").collect()
    slow = step(rows).orderBy("row").collect()
    assert fast == slow and fast[0]["ids_name"] == ["one", "two"]
    places = spark.createDataFrame([(1, "DE", "Here")], "id bigint, country_code string, name string")
    coded = spark.createDataFrame([(1, ["DE1", "FR1", "null", "free text"])], "row int, a_region array<string>")
    step = DecodeRegions("_region", places)
    assert step.fit(coded)(coded).first()["a_region_name"] == ["Here, DE", None, "free text"]
    assert step(coded).first()["a_region_name"] == ["Here, DE", None, "free text"]


def test_long_tables_decode_rows_that_repeat(spark):
    table = spark.range(700).selectExpr("id", "concat('n', id) AS name")
    rows = spark.createDataFrame([(1, ["1", "2"]), (1, ["3"]), (1, ["1", "2"])], "row int, ids array<string>")
    got = DecodeIds("ids", table).fit_transform(rows).collect()
    assert sorted(r["ids_name"] for r in got) == [["n1", "n2"], ["n1", "n2"], ["n3"]]
    places = spark.range(700).selectExpr("id", "'DE' AS country_code", "concat('p', id) AS name")
    coded = spark.createDataFrame([(["DE1", "x"],), (["DE2"],), (["DE1", "x"],)], "a_region array<string>")
    got = DecodeRegions("_region", places).fit_transform(coded).collect()
    assert sorted(r["a_region_name"] for r in got) == [["p1, DE", "x"], ["p1, DE", "x"], ["p2, DE"]]


def test_whole_numbers_stay_whole(spark):
    rows = spark.createDataFrame([(1, 9007199254740993, 2), (1, 5, 3)], "k int, x bigint, y int")
    out = GroupRows(("k",), by_column={"x": "max", "y": "sum"}).transform(rows)
    assert out.first()["x"] == 9007199254740993 and dict(out.dtypes)["y"] == "bigint"


def test_outlier_limit_follows_the_lower_median(spark):
    rows = spark.createDataFrame([(v,) for v in [1.0] * 5 + [100.0] * 5], "x double")
    spread = np.std([1.0] * 5 + [100.0] * 5, ddof=1)
    assert OutlierRule("x", 0.1).fit(rows).limit == pytest.approx(0.1 * spread)


def test_grid_with_gaps(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01", 5.0, "x"), ("a", "2024-01-03", 7.0, None), ("b", "2024-01-04", 1.0, "y"), (None, "2024-01-02", 9.0, "z")],
        "g string, d string, v double, w string").withColumn("d", F.to_timestamp("d").cast("timestamp_ntz"))
    done = TimeGrid("d", ("g",)).fit_transform(rows)
    assert done.columns == ["g", "d", "v", "w"]
    assert done.count() == 8 and done.agg(F.sum("v")).first()[0] == 13.0
    assert done.where("g = 'a' and v = 0").count() == 2


def test_grid_by_month(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-04-01", 2), ("a", "2024-02-15", 3)], "g string, d string, v int")
    rows = rows.withColumn("d", F.to_timestamp("d").cast("timestamp_ntz"))
    done = TimeGrid("d", ("g",), "1MS").fit_transform(rows)
    assert sorted((r["d"].month, r["v"]) for r in done.collect()) == [(1, 1), (2, 0), (3, 0), (4, 2)]


def test_whole_table_operators_refuse_streams(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    with pytest.raises(BatchOnly):
        GroupValue(("user_id",))(stream)
    assert Chain((SignedLog(("value",)),))(stream).isStreaming


def test_stored_tables_go_to_the_named_folder(spark):
    folder = shared_dir(spark)
    assert folder == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    kept = stored(spark.range(5), "numbers")
    assert all(folder in f for f in kept.inputFiles()) and kept.count() == 5
    assert cut_lineage(spark.range(3)).count() == 3


def test_chain_splits_before_changed_columns():
    chain = Chain((SignedLog(("a",)), SignedLog(("b",)), SignedLog(("c",))))
    first, rest = chain.split_at(["b"])
    assert len(first.steps) == 1 and len(rest.steps) == 2


def test_chain_does_not_split_behind_steps_that_may_read_the_columns():
    whole = GroupRows(("g",), by_column={"x": "sum"})
    assert [len(c.steps) for c in Chain((SignedLog(("a",)), whole, SignedLog(("x",)))).split_at(["x"])] == [1, 2]
    assert [len(c.steps) for c in Chain((Apply(lambda df: df), SignedLog(("x",)))).split_at(["x"])] == [0, 2]
    assert [len(c.steps) for c in Chain((FillMissing(), SignedLog(("x",)))).split_at(["x"])] == [0, 2]


@pytest.mark.parametrize("keys", [["g"], []])
def test_places_in_groups_of_any_size(spark, keys):
    from loomwright.plans.ranks import ranked

    rows = [(None if k % 50 == 0 else 1 if k % 3 else k % 7, k * 7919 % 1000 // 2, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, k int")
    got = ranked(df, keys, [F.col("v"), F.col("k")]).collect()
    groups = {}
    for g, v, k in rows:
        groups.setdefault(g if keys else 0, []).append((v, k, g))
    want = {(g, v, k): place for own in groups.values() for place, (v, k, g) in enumerate(sorted(own, key=lambda x: x[:2]))}
    assert {(r.g, r.v, r.k): r["rank"] for r in got} == want
    tied = ranked(df, keys, [F.col("v")], tie="number").collect()
    assert sorted((r.g or 0, r["rank"]) if keys else r["rank"] for r in tied) == sorted((r.g or 0, r["rank"]) if keys else r["rank"] for r in got)


def test_group_moments_of_wide_rows(spark):
    """80 columns per group, one group with most rows: exact, and no matrix per batch is shuffled."""
    draw = np.random.default_rng(6)
    x = draw.normal(3, 2, size=(1500, 80))
    group = [None if k % 100 == 0 else "hot" if k % 3 else f"g{k % 7}" for k in range(1500)]
    rows = spark.createDataFrame([(g, *map(float, r)) for g, r in zip(group, x)], "g string, " + ", ".join(f"c{k} double" for k in range(80)))
    for slice_rows in (500_000, 100):
        got = _by_matrices(rows.repartition(6), [f"c{k}" for k in range(80)], ["g"], slice_rows).collect()
        assert sorted(str(r["g"]) for r in got) == sorted({str(g) for g in group})
        for r in got:
            own = x[[k for k, g in enumerate(group) if g == r["g"]]]
            assert r["n"] == len(own) and r["mean"] == pytest.approx(own.mean(0))
            assert np.reshape(r["cov"], (80, 80)) == pytest.approx(np.cov(own.T, bias=True), abs=1e-9)


def test_large_groups_are_added_up_where_they_are_read(spark):
    """Their rows are not shuffled; with room for one matrix only, some groups go by matrix, some by slices, some whole."""
    x = np.random.default_rng(8).normal(3, 2, size=(3000, 20))
    names = [f"c{k}" for k in range(20)]
    group = [None if k % 50 == 1 else k % 3 if k % 10 else 7 if k % 20 else 8 for k in range(3000)]
    rows = spark.createDataFrame([(g, *map(float, r)) for g, r in zip(group, x)], "g int, " + ", ".join(f"{c} double" for c in names))
    even = rows.where("g < 3").repartition(6)
    assert "REPARTITION_BY_COL" not in _by_matrices(even, names, ["g"])._jdf.queryExecution().toString()
    for table, held in ((even, 1 << 24), (rows.repartition(6), 3 * 8 * 20 * 21), (rows.repartition(6), 0)):
        got = _by_matrices(table, names, ["g"], 200, held).collect()
        used = {g for g in group if table is not even and (g is None or g > 2)} | {0, 1, 2}
        assert len(got) == len(used) and {r["g"] for r in got} == used
        for r in got:
            own = x[[k for k, g in enumerate(group) if g == r["g"]]]
            assert r["n"] == len(own) and r["mean"] == pytest.approx(own.mean(0))
            assert np.reshape(r["cov"], (20, 20)) == pytest.approx(np.cov(own.T, bias=True), abs=1e-9)
    assert _by_matrices(rows.limit(0), names, ["g"]).collect() == []


def test_covariance_in_bands(spark):
    x = np.random.default_rng(7).normal(size=(200, 9))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    for tile in (1 << 22, 30, 1):
        assert array_moments(df, "v", 9, tile).cov == pytest.approx(np.cov(x.T, bias=True))


def test_codes_of_any_dictionary(spark):
    rows = spark.range(0, 4000, 1, 4).select(
        "id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), (F.col("id") % 1700).cast("string"))).alias("t"),
        F.when(F.col("id") % 7 > 0, F.array((F.col("id") % 1500).cast("double"), F.lit(float("nan")), F.lit(None).cast("double"))).alias("l"))
    fitted = Codes(("t", "l")).fit(rows)
    got = {r["id"]: r for r in fitted(rows).collect()}
    order = {v: k for k, v in enumerate(sorted({f"v{i % 1700}" for i in range(4000) if i % 5}))}
    numbers = {v: k for k, v in enumerate(sorted({i % 1500 for i in range(4000) if i % 7}))}
    assert len(got) == 4000
    for i, r in got.items():
        assert r["t_index"] == (order[f"v{i % 1700}"] if i % 5 else None)
        assert r["l_indices"] == ([numbers[i % 1500]] if i % 7 else None)
    new = fitted(spark.createDataFrame([(1, "unknown", [3.0, -1.0]), (2, None, [])], "id bigint, t string, l array<double>")).orderBy("id").collect()
    assert [(r["t_index"], r["l_indices"]) for r in new] == [(None, [numbers[3]]), (None, [])]


def test_long_and_strict_maps(spark):
    rows = spark.createDataFrame([(1, ["1", "x"]), (700, None), (None, [])], "k int, l array<string>")
    given = {"k": {k: k * 2 for k in range(800)}, "l": {str(k): f"n{k}" for k in range(800)}}
    got = MapValues(("k", "l"), given)(rows).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(None, []), (2, ["n1", None]), (1400, None)]
    assert MapValues(("k",), {"k": given["k"]}, strict=True)(rows).count() == 3
    with pytest.raises(Exception, match="no mapping in k"):
        MapValues(("k",), {"k": given["k"]}, strict=True)(spark.createDataFrame([(999,)], "k int")).collect()


@pytest.mark.parametrize("freq", ["6H", "2D", "1W", "MS", "2QS", "90S"])
def test_rows_move_back_to_their_step(spark, freq):
    import pandas as pd

    draw = np.random.default_rng(3)
    stamps = pd.Timestamp("2024-01-30 07:11:13") + pd.to_timedelta(draw.integers(0, 86400 * 2 if freq == "90S" else 86400 * 200, 300), "s")
    rows = spark.createDataFrame([("a" if k % 3 else "b", t.to_pydatetime(), 1) for k, t in enumerate(stamps)], "g string, t timestamp_ntz, n int")
    step = TimeGrid("t", ("g",), freq=freq, truncate=True).fit(rows)
    done = step(rows).toPandas()
    assert done["n"].sum() == 300
    marks = sorted(done["t"].unique())
    assert set(done[done["g"] == "a"]["t"]) == set(done[done["g"] == "b"]["t"])
    for (t, n) in done.groupby("t")["n"].sum().items():
        following = [m for m in marks if m > t]
        assert n == ((stamps >= t) & ((stamps < following[0]) if following else True)).sum()


def test_one_second_grid_is_made_in_blocks(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-12 00:00:00", 1)], "g string, t string, n int").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    done = TimeGrid("t", ("g",), freq="1S").fit_transform(rows)
    facts = done.withColumn("part", F.spark_partition_id()).agg(F.count("*"), F.sum("n"), F.count_distinct("t"), F.count_distinct("part")).first()
    assert tuple(facts[:3]) == (11 * 86400 + 1, 2, 11 * 86400 + 1) and facts[3] > 4


def test_metric_rows_of_a_split_without_name(spark):
    from loomwright.operators.metrics import metric_rows

    rows = spark.createDataFrame([(s, float(k % 7), float(k % 5)) for k in range(200) for s in (None, "x")], "s string, y double, p double")
    got = {r["s"]: tuple(r)[1:] for r in metric_rows(rows, "y", "p", "s").collect()}
    assert got[None] == pytest.approx(got["x"]) and got[None][-1] > 0


def test_sums_of_blocks_in_any_order():
    draw = np.random.default_rng(11)
    x = draw.normal(1e7, 1, size=(3000, 4))
    x[1500:] -= 2e7
    parts = []
    for low, high in ((0, 1), (1, 2500), (2500, 3000)):
        parts.append(Sums(4))
        parts[-1].add(x[low:high])
    whole = Sums(4)
    for part in reversed(parts):
        whole.merge(part.n, part.mean, part.products)
    assert whole.n == 3000 and whole.mean == pytest.approx(x.mean(0), rel=1e-9, abs=1e-3)
    assert whole.products / 3000 == pytest.approx(np.cov(x.T, bias=True), rel=1e-9)
