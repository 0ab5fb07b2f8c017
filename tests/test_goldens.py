"""Exact inputs with exact outputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import arrays, calendar, mathops
from loomwright.operators import embed, features
from loomwright.operators.aggregate import GroupRows, GroupValue, OncePerGroup
from loomwright.operators.encode import MultiHot, OneHot
from loomwright.operators.lookup import MapValues
from loomwright.operators.select import FillEmptyGroup, OutlierRule, PlayableVideos
from loomwright.plans.operator import Apply


def test_first_row_of_group_is_joined_back(spark):
    rows = spark.createDataFrame(
        [("A", 1, 5), ("A", 2, 6), ("B", 3, 7), ("B", 4, 8)], "group_column string, column1 long, column2 long")
    double = Apply(lambda df: df.withColumn("transformed_column", F.col("column1") * 2))
    done = OncePerGroup(("group_column",), double, ("column1",), ("column2",))(rows)
    assert [r["transformed_column"] for r in done.orderBy("column2").collect()] == [2, 2, 6, 6]


def test_bump_over_seven_points(spark):
    expected = [0, 0.17139488, 0.65309954, 1, 0.65309954, 0.17139488, 0]
    assert mathops.bump_values(range(-3, 4)) == pytest.approx(expected, abs=1e-7)
    points = F.array(*[F.lit(float(x)) for x in range(-3, 4)])
    assert spark.range(1).select(mathops.bump(points).alias("b")).first()["b"] == pytest.approx(expected, abs=1e-7)


def test_sine_of_a_week(spark):
    rows = spark.createDataFrame([(float(k % 7),) for k in range(14)], "ts double")
    for peaks in ({"ts": 7}, None):
        done = features.SineTime(("ts",), peaks).fit_transform(rows).collect()
        for r in done:
            assert r["ts_num_cont"] == pytest.approx(math.sin(2 * math.pi * r["ts"] / 7), abs=1e-12)


def test_list_text_is_decoded_where_all_cells_parse(spark):
    a = [str([k, *range(10)]) for k in range(10)]
    c = ["[" + ", ".join(f'{{"{j}-1": {j * j}}}' for j in range(10)) + "]" for _ in range(10)]
    b = ["no list " + str(k) for k in range(10)]
    rows = spark.createDataFrame(list(zip(a, b, c)), "a string, b string, c string")
    done = features.DecodeText().fit_transform(rows)
    first = done.orderBy("a").first()
    assert len(first["a"]) == 11 and len(first["c"]) == 10 and first["b"].startswith("no list")


def test_first_elements(spark):
    rows = spark.createDataFrame([([1.0, 3.0], [2.0], ["j", "k"]), (None, [2.0], [])], "a array<double>, b array<double>, c array<string>")
    done = embed.First(("a", "c"))(rows).collect()
    assert (done[0]["a"], done[0]["b"], done[0]["c"]) == (1.0, [2.0], "j")
    assert done[1]["a"] is None and done[1]["c"] is None


def test_re_encoded_videos_are_dropped(spark):
    rows = spark.createDataFrame([(["video.mp4", "video_756k_800_1200_756k.mp4"],)], "videos array<string>")
    assert PlayableVideos(("videos",))(rows).first()["videos"] == ["video.mp4"]


@pytest.mark.parametrize("names, root", [
    (["abd_0", "abd_1", "abd_2"], "abd"), (["kls_o_0", "kls_o_1"], "kls_o"), (["_f_7__0", "_f_7__1"], "_f_7"),
    (["x", "y"], None),
])
def test_root_names(names, root):
    assert arrays.root_name(names) == root


def test_packed_column_name(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "abd_0 double, abd_1 double")
    assert embed.Pack(("abd_0", "abd_1"))(rows).first()["abd"] == [1.0, 2.0]
    assert embed.Pack(("abd_0", "abd_1"), "peter", drop=True)(rows).columns == ["peter"]


def test_overlap_counts(spark):
    """24 ones, windows of 16 every 4 with unit weights: corners 1, edges 2, centre 4."""
    rows = spark.createDataFrame([([1.0] * 24,)], "v array<double>")
    step = embed.OverlapGrid(("v",), 24, 16, 4, 0, weights=[1.0] * 16)
    edge, _ = step.edge_and_taps()
    grid = np.array(step(rows).first()["v_2d"]).reshape(edge, edge)
    assert edge == 8 and grid[0, 0] == 1 and grid[0, 3] == 2 and grid[3, 3] == 4


def test_padded_windows(spark):
    cut = spark.range(1).select(arrays.windows(F.array(*[F.lit(float(k)) for k in range(6)]), 6, 4, 2, 1).alias("w")).first()["w"]
    assert cut == [[0.0, 0.0, 1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [3.0, 4.0, 5.0, 0.0]]


def test_one_hot_rows_sum_to_one_and_remember_items(spark):
    rows = spark.createDataFrame([(f"c_{k % 9}",) for k in range(80)], "cat string")
    step = OneHot(("cat",)).fit(rows)
    done = step(rows)
    flags = [c for c in done.columns if c.startswith("cat_")]
    assert flags == [f"cat_c_{k}" for k in range(9)]
    total = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    assert done.where(total != 1).count() == 0
    other = step(spark.createDataFrame([("new",), (None,)], "cat string"))
    assert other.columns == done.columns and other.where(F.col("cat_c_0")).count() == 0


def test_multi_hot(spark):
    rows = spark.createDataFrame([(["b", "a", "a"],), ([],), (None,)], "l array<string>")
    done = MultiHot(("l",)).fit_transform(rows).collect()
    assert [(r["l_a"], r["l_b"]) for r in done] == [(True, True), (False, False), (False, False)]


def test_too_many_items_raise(spark):
    with pytest.raises(ValueError):
        OneHot(("id",), max_items=5).fit(spark.range(10))


def test_log_column_follows_aggregate(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 0.0), ("b", 5.0, 0.0)], "id string, f double, log_f double")
    done = {r["id"]: r for r in GroupRows(("id",))(rows).collect()}
    assert done["a"]["log_f"] == pytest.approx(math.log1p(2.0)) and done["b"]["f"] == 5.0


def test_null_keys_drop_out(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", 3)], "k string, v int")
    done = GroupValue(("k",))(rows)
    assert sorted(r["v"] for r in done.collect()) == [1, 3] and done.first()["k_len"] == 2


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "k string, v double")
    assert GroupRows(("k",))(rows).first()["v"] == 2.0


def test_log_predictions(spark):
    values = [0.0, 1.0, -1.0, 709.7, 710.5, 711.6, 712.0, 720.0, float("-inf"), float("nan"), float("inf")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, log_imps double")
    done = [r["imps"] for r in features.UnlogColumns()(rows).orderBy("i").collect()]

    def step_by_step(v):
        n = 1
        with np.errstate(over="ignore"):
            out = np.expm1(v)
            while not np.isfinite(out) and n < 20:
                v -= 0.1
                out, n = np.expm1(v), n + 1
        return out if np.isfinite(out) else abs(v) * 10_000

    for got, v in zip(done[:8], values):
        assert got == pytest.approx(step_by_step(v), rel=1e-9)
    assert done[8] == -1.0


def test_factors_and_inverse(spark):
    rows = spark.createDataFrame([(2.0, 4.0)], "a double, b double")
    step = features.Factors(("a", "b"), (1.0, 3.0))
    assert tuple(step(rows).first()) == (0.5, 3.0)
    assert tuple(step.inverse(step(rows)).first()) == (2.0, 4.0)
    assert mathops.factors([1, 1], 0.2)[0] == pytest.approx([0.6, 0.6])
    assert mathops.factors([1, 1], 3.0) == ([0.5, 0.5], 3.0)


def test_cosine_factors_sum_to_one():
    assert sum(calendar.cosine_factors(7)) == pytest.approx(1.0)
    assert max(range(7), key=calendar.cosine_factors(7).__getitem__) == 3


def test_bumped_one_hot_needs_exactly_one(spark):
    rows = spark.createDataFrame([(True, False, False), (True, True, False), (False, False, False)], "c_0 boolean, c_1 boolean, c_2 boolean")
    done = features.BumpedOneHot(("c_0", "c_1", "c_2"))(rows).collect()
    assert done[0]["c_0_gau"] == 1.0 and done[1]["c_0_gau"] is None and done[2]["c_1_gau"] is None


def test_polynomial_names():
    names = [n for n, _ in mathops.monomials(["a", "b"], 2)]
    assert names == ["1", "a", "b", "a^2", "a b", "b^2"]
    assert [n for n, _ in mathops.monomials(["a", "b"], 2, False, True)] == ["a", "b", "a b"]


def test_switch_on_empty_flags(spark):
    rows = spark.createDataFrame([(False, False), (True, False)], "x_a boolean, x_b boolean")
    assert [tuple(r) for r in FillEmptyGroup(("x_a", "x_b"))(rows).collect()] == [(True, True), (True, False)]


def test_strict_map_raises(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "v string")
    with pytest.raises(Exception, match="no mapping"):
        MapValues(("v",), {"v": {"a": 1}}, strict=True)(rows).collect()


def test_outlier_rule_without_spread_flags_nothing(spark):
    rows = spark.createDataFrame([(1.0,)] * 5, "m double")
    assert OutlierRule("m").fit_transform(rows).where("outlier").count() == 0


def test_outlier_rule_grows_until_half(spark):
    values = [10.0] * 6 + [0.0] * 4
    rows = spark.createDataFrame([(v,) for v in values], "m double")
    done = OutlierRule("m", threshold=0.5).fit_transform(rows)
    assert done.where("outlier").count() <= 5


def test_age_histogram_counts_every_age(spark):
    rows = spark.createDataFrame([([1], [120]), ([], []), (None, None)], "lo array<bigint>, hi array<bigint>")
    done = features.AgeHistogram(("lo", "hi"), normalize=False)(rows).collect()
    counts = [done[0][f"age_hist_{k}"] * 10 for k in range(12)]
    assert sum(counts) == pytest.approx(120)
    expected = np.histogram(np.arange(1, 121), bins=12, range=(1, 120))[0]
    assert counts == pytest.approx(expected)
    assert [done[1][f"age_hist_{k}"] for k in range(12)] == [1.0] * 12
    unit = features.AgeHistogram(("lo", "hi"))(rows).collect()[2]
    assert sum(unit[f"age_hist_{k}"] ** 2 for k in range(12)) == pytest.approx(1.0)


def test_json_with_missing_fields(spark):
    rows = spark.createDataFrame(
        [(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": 2.5}'), (3, None), (4, "")], "id int, j string")
    done = features.FlattenJson("j").fit_transform(rows).orderBy("id")
    assert done.columns == ["id", "a", "b.c"]
    assert [r["b.c"] for r in done.collect()] == ["x", None, None, None]
    assert float(done.collect()[1]["a"]) == 2.5


def test_weekday_of_text_and_bad_text(spark):
    rows = spark.createDataFrame([("2024-01-01", 1), ("never", 2)], "event_date string, n int")
    done = features.WeekdayName(("event_date", "n"))(rows).collect()
    assert [r["event_weekday"] for r in done] == ["Monday", None]
