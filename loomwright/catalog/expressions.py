"""Row-wise operators: calendar, factors, curves, text, predicates, casts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loomwright.catalog.registry import query, rounded, table, text_list
from loomwright.functions import text
from loomwright.operators import features, select
from loomwright.operators.encode import OneHot
from loomwright.operators.lookup import MapValues

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"SELECT {LINE}, dayname(l_shipdate) AS weekday FROM lineitem")
def weekday_names(spark, sf):
    rows = table(spark, sf, "lineitem")
    return features.WeekdayName(("l_shipdate",))(rows).select(*LINE_KEYS, "weekday")


@query("""
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
       CAST(day(o_orderdate) AS INTEGER) AS day, CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(dayofyear(o_orderdate) AS INTEGER) AS dayofyear
FROM orders""")
def season_fields(spark, sf):
    rows = table(spark, sf, "orders")
    seasons = ("month", "quarter", "day", "year", "weekday", "dayofyear")
    for season in seasons:
        rows = features.SeasonField(("o_orderdate",), season)(rows)
    return rows.select("o_orderkey", *seasons)


@query("SELECT o_orderkey, monthname(o_orderdate) AS month, dayname(o_orderdate) AS day FROM orders")
def season_names(spark, sf):
    rows = table(spark, sf, "orders")
    for season in ("month", "day"):
        rows = features.SeasonField(("o_orderdate",), season, naming=True)(rows)
    return rows.select("o_orderkey", "month", "day")


@query("""
WITH p AS (SELECT max(hour(ts)) + 1 AS ph, max(isodow(ts) - 1) + 1 AS pw FROM events)
SELECT event_id, round(sin(2 * pi() * hour(ts) / ph), 6) + 0.0 AS hour_num_cont,
       round(sin(2 * pi() * (isodow(ts) - 1) / pw), 6) + 0.0 AS weekday_num_cont,
       round(sin(2 * pi() * value / 100), 6) + 0.0 AS value_num_cont
FROM events, p""")
def sine_time(spark, sf):
    rows = table(spark, sf, "events")
    step = features.SineTime(("hour", "weekday", "value"), {"value": 100}, time_column="ts")
    names = ("hour_num_cont", "weekday_num_cont", "value_num_cont")
    return step.fit_transform(rows).select("event_id", *[rounded(c).alias(c) for c in names])


@query(f"""
SELECT {LINE}, round(l_quantity * 0.1, 6) AS l_quantity, round(l_extendedprice * 0.325, 6) AS price_part,
       round(l_discount * 0.55, 6) AS l_discount, round(l_tax * 0.325, 6) AS l_tax
FROM lineitem""")
def cosine_period(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("price_part", F.col("l_extendedprice"))
    columns = ("l_quantity", "price_part", "l_discount", "l_tax")
    done = features.cosine_factors(columns, bias=0.1)(rows)
    return done.select(*LINE_KEYS, *[rounded(c).alias(c) for c in columns])


@query(f"""
SELECT {LINE}, round(l_quantity * 0.2 + 2, 6) AS l_quantity_wfac, round(l_discount * 0.3 + 2, 6) AS l_discount_wfac,
       round(l_tax * 0.5 + 2, 6) AS l_tax_wfac, round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount
FROM lineitem""")
def weighted_factors(spark, sf):
    rows = table(spark, sf, "lineitem")
    step = features.Factors(("l_quantity", "l_discount", "l_tax"), (2.0, 3.0, 5.0), bias=2.0, suffix="_wfac")
    done = step.inverse(step(rows).drop("l_quantity", "l_discount"))
    names = ("l_quantity_wfac", "l_discount_wfac", "l_tax_wfac", "l_quantity", "l_discount")
    return done.select(*LINE_KEYS, *[rounded(c).alias(c) for c in names])


@query(f"""
SELECT {LINE}, round(l_quantity / 3.0, 6) AS l_quantity, round(l_discount / 3.0, 6) AS l_discount,
       CAST(0 AS DOUBLE) AS not_there
FROM lineitem""")
def uniform_factors(spark, sf):
    columns = ("l_quantity", "l_discount", "not_there")
    done = features.uniform_factors(columns)(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, *[rounded(c).alias(c) for c in columns])


@query(f"""
SELECT {LINE}, round(sign(l_extendedprice - 50000) * ln(1 + abs(l_extendedprice - 50000)), 6) + 0.0 AS off_centre
FROM lineitem""")
def signed_log(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("off_centre", F.col("l_extendedprice") - 50000)
    return features.SignedLog(("off_centre",))(rows).select(*LINE_KEYS, rounded("off_centre").alias("off_centre"))


@query(f"""
WITH v AS (SELECT {LINE}, l_quantity * 14.2::DOUBLE + l_discount * 20 AS v FROM lineitem),
     s AS (SELECT *, greatest(0, ceil((v - 709.782712893384::DOUBLE) / 0.1::DOUBLE)) AS j FROM v)
SELECT {LINE}, round(CASE WHEN j <= 19 THEN v - 0.1::DOUBLE * j ELSE ln(1 + abs(v - 1.9::DOUBLE) * 10000) END, 6) AS log_back
FROM s""")
def log_predictions_undone(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("log_imps", F.col("l_quantity") * 14.2 + F.col("l_discount") * 20)
    done = features.UnlogColumns()(rows)
    return done.select(*LINE_KEYS, rounded(F.log1p("imps")).alias("log_back"))


@query("""
WITH w AS (SELECT o_orderkey, isodow(o_orderdate) - 1 AS w FROM orders),
     m AS (SELECT *, exp(-0.5 * pow(greatest(w, 6 - w) / 1.1::DOUBLE, 2)) AS low FROM w)
SELECT o_orderkey, """ + ", ".join(
    f"round((exp(-0.5 * pow(({k} - w) / 1.1::DOUBLE, 2)) - low) / (1 - low), 6) + 0.0 AS weekday_{k}_gau"
    for k in range(7)) + " FROM m")
def bumped_weekday(spark, sf):
    rows = features.SeasonField(("o_orderdate",), "weekday")(table(spark, sf, "orders"))
    flags = OneHot(("weekday",), {"weekday": list(range(7))})(rows)
    done = features.BumpedOneHot(tuple(f"weekday_{k}" for k in range(7)))(flags)
    return done.select("o_orderkey", *[rounded(f"weekday_{k}_gau").alias(f"weekday_{k}_gau") for k in range(7)])


@query(f"""
SELECT {LINE}, CAST(1 AS DOUBLE) AS "poly_1", round(l_quantity, 6) AS "poly_l_quantity",
       round(l_discount, 6) AS "poly_l_discount", round(l_tax, 6) AS "poly_l_tax",
       round(l_quantity * l_quantity, 6) AS "poly_l_quantity^2", round(l_quantity * l_discount, 6) AS "poly_l_quantity l_discount",
       round(l_quantity * l_tax, 6) AS "poly_l_quantity l_tax", round(l_discount * l_discount, 6) AS "poly_l_discount^2",
       round(l_discount * l_tax, 6) AS "poly_l_discount l_tax", round(l_tax * l_tax, 6) AS "poly_l_tax^2"
FROM lineitem""")
def polynomial_terms(spark, sf):
    done = features.Polynomial(("l_quantity", "l_discount", "l_tax"), degree=2)(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, *[rounded(f"`{c}`").alias(c) for c in done.columns if c.startswith("poly_")])


@query(f"""
WITH x AS (SELECT *, l_quantity - 10 AS x FROM lineitem),
     s AS (SELECT *, sign(x) * pow(abs(x), 0.7::DOUBLE) AS s FROM x)
SELECT {LINE}, round(CASE WHEN s + 1.5::DOUBLE = 0 THEN 1e-8 ELSE s / (s + 1.5::DOUBLE) END, 6) + 0.0 AS response,
       round(sign(x) * pow(abs(x), 0.7::DOUBLE) / (pow(abs(x), 0.7::DOUBLE) + 1.5::DOUBLE), 6) + 0.0 AS magnitude
FROM s""")
def saturating_response(spark, sf):
    from loomwright.functions.mathops import adbudg

    x = F.col("l_quantity") - 10
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS, rounded(adbudg(x, 0.7, 1.5)).alias("response"),
        rounded(adbudg(x, 0.7, 1.5, magnitude=True)).alias("magnitude"),
    )


@query(f"""
WITH m AS (SELECT min(l_quantity) AS low FROM lineitem),
     x AS (SELECT lineitem.*, l_quantity + low + 1e-8 AS x FROM lineitem, m)
SELECT {LINE}, round(exp(-pow(ln(x) - 1.2::DOUBLE, 2) / (2 * 0.8::DOUBLE * 0.8)) / (x * 0.8::DOUBLE * sqrt(2 * pi())), 6) AS response
FROM x""")
def lognormal_response(spark, sf):
    from loomwright.functions.mathops import lognormal

    rows = table(spark, sf, "lineitem")
    low = rows.agg(F.min("l_quantity")).first()[0]
    return rows.select(*LINE_KEYS, rounded(lognormal(F.col("l_quantity"), 0.8, 1.2, low)).alias("response"))


@query("""
SELECT o_orderkey, round(o_totalprice * 1.0733::DOUBLE, 6) AS booked_revenue_usd,
       round(least(o_totalprice / 100, 1300) * 81.589082::DOUBLE + pow(least(o_totalprice / 100, 1300), 2) * 0.189342::DOUBLE
             - pow(least(o_totalprice / 100, 1300), 3) * 0.000104::DOUBLE, 3) + 0.0 AS expected
FROM orders""")
def currency_and_curve(spark, sf):
    from loomwright.operators.metrics import CURVE, CURVE_CUT

    rows = features.ScaledColumn("o_totalprice")(table(spark, sf, "orders"))
    rows = rows.withColumn("x", F.col("o_totalprice") / 100)
    done = features.ReferenceCurve("x", "expected", CURVE, CURVE_CUT)(rows)
    return done.select("o_orderkey", rounded("booked_revenue_usd", 6).alias("booked_revenue_usd"),
                       rounded("expected", 3).alias("expected"))


DEVICES = {"click": "phone", "view": "laptops", "signup": "tablet", "purchase": "mobile phones", "error": "radio"}
MORE_DEVICES = ["pc", "mediaplayer", "connected tv", "desktops"]


def named_events(spark, sf):
    kind = F.create_map(*[F.lit(x) for pair in DEVICES.items() for x in pair])
    more = F.array(*[F.lit(d) for d in MORE_DEVICES])
    return table(spark, sf, "events").withColumn(
        "device_type", F.array(kind[F.col("event_type")], F.get(more, (F.col("user_id") % 4).cast("int"))))


DEVICE_SQL = ("[CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEVICES.items()) + " END, "
              "['pc', 'mediaplayer', 'connected tv', 'desktops'][user_id % 4 + 1]]")


@query(f"""
SELECT event_id, coalesce(array_to_string(list_filter(list_transform({DEVICE_SQL},
       lambda d: regexp_replace(regexp_replace(d, 'phone|mediaplayer|mobile phones|mobiles', 'mobile', 'g'),
                                'pc|desktops|laptops', 'desktop', 'g')),
       lambda d: regexp_matches(d, 'desktop|tablet|mobile')), '|'), '') AS device_type
FROM events""")
def device_types(spark, sf):
    done = features.DeviceTypes()(named_events(spark, sf))
    return done.select("event_id", text_list("device_type").alias("device_type"))


BROWSERS_SQL = """[CASE event_type WHEN 'click' THEN 'Chrome ' WHEN 'view' THEN 'Mozilla Firefox ' WHEN 'signup'
  THEN 'Safari on iPhone ' WHEN 'purchase' THEN 'Samsung Internet ' ELSE 'Lynx ' END || user_id, 'Microsoft Edge ...', 'Opera']"""


@query("SELECT event_id, array_to_string(list_filter(list_transform(" + BROWSERS_SQL + """, lambda b: CASE
  """ + " ".join(
    f"WHEN contains(regexp_replace(regexp_replace(b, ' [0-9]+$', ''), ' (\\.+)$', ''), '{b}') THEN '{b}'"
    for b in text.BROWSERS) + """ END), lambda b: b IS NOT NULL), '|') AS browser_targets FROM events""")
def browser_names(spark, sf):
    maker = F.create_map(*[F.lit(x) for x in (
        "click", "Chrome ", "view", "Mozilla Firefox ", "signup", "Safari on iPhone ",
        "purchase", "Samsung Internet ", "error", "Lynx ")])
    rows = table(spark, sf, "events").withColumn("browser_targets", F.array(
        F.concat(maker[F.col("event_type")], F.col("user_id").cast("string")), F.lit("Microsoft Edge ..."), F.lit("Opera")))
    done = features.CanonicalNames("browser_targets")(rows)
    return done.select("event_id", text_list("browser_targets").alias("browser_targets"))


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 5 END AS priority,
       CAST((SELECT count(DISTINCT s.o_orderstatus) FROM orders s WHERE s.o_orderstatus < o.o_orderstatus) AS INTEGER) AS status
FROM orders o""")
def value_map(spark, sf):
    rows = table(spark, sf, "orders").withColumnsRenamed({"o_orderpriority": "priority", "o_orderstatus": "status"})
    given = {"priority": {"1-URGENT": 1, "2-HIGH": 2, "5-LOW": 5}}
    done = MapValues(("priority", "status"), given).fit_transform(rows)
    return done.select("o_orderkey", "priority", "status")


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w:
       CASE w WHEN 'red' THEN 'colour' WHEN 'ring' THEN 'thing' WHEN 'plate' THEN 'thing' ELSE '~' END), '|') AS words
FROM part""")
def list_value_map(spark, sf):
    rows = table(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    done = MapValues(("words",), {"words": {"red": "colour", "ring": "thing", "plate": "thing"}}).fit_transform(rows)
    return done.select("p_partkey", text_list("words").alias("words"))


@query("SELECT p_partkey, p_name || '. ' || p_brand || '. ' || p_type AS text FROM part")
def joined_texts(spark, sf):
    return features.JoinTexts(("p_name", "p_brand", "p_type"))(table(spark, sf, "part")).select("p_partkey", "text")


@query("""
SELECT doc_id, regexp_full_match(trim(substr(source, 4)), '[+-]?[0-9]+') AS source_is_number,
       regexp_full_match(trim(lang), '[+-]?[0-9]+') AS lang_is_number
FROM documents""")
def integer_text(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select(
        "doc_id", text.is_integer(F.substr("source", F.lit(4))).alias("source_is_number"),
        text.is_integer(F.col("lang")).alias("lang_is_number"),
    )


@query("SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def renamed_columns(spark, sf):
    # the second target exists already and the third source does not, so both are left alone
    return select.Rename({"n_nationkey": "id", "n_regionkey": "n_name", "not_there": "x"})(table(spark, sf, "nation"))


@query("""
SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand, TRY_CAST(p_name AS INTEGER) AS p_name,
       CAST(p_size AS DOUBLE) AS p_size
FROM part""")
def best_effort_cast(spark, sf):
    rows = table(spark, sf, "part").withColumn("brand", F.substr("p_brand", F.lit(7)))
    done = select.Cast({"brand": "int", "p_name": "int", "p_size": "double", "not_there": "int"})(rows)
    return done.select("p_partkey", "brand", "p_name", "p_size")


@query("""
SELECT 'brand' AS "column", CAST(count(*) FILTER (TRY_CAST(substr(p_brand, 7) AS INTEGER) IS NULL) AS BIGINT) AS lost FROM part
UNION ALL SELECT 'p_name', CAST(count(*) FILTER (TRY_CAST(p_name AS INTEGER) IS NULL) AS BIGINT) FROM part""")
def cells_lost_by_cast(spark, sf):
    rows = table(spark, sf, "part").withColumn("brand", F.substr("p_brand", F.lit(7)))
    return select.Cast({"brand": "int", "p_name": "int"}).lost(rows)


@query(f"""
SELECT {LINE}, coalesce(nullif(l_discount, 0.05), 0) AS gappy, coalesce(nullif(l_tax, 0.02), 0) AS nan_gaps,
       l_linestatus = 'O' AND l_returnflag <> 'A' AS flag, CASE WHEN l_quantity > 25 THEN l_returnflag END AS word,
       CAST(0 AS DOUBLE) AS absent_feature
FROM lineitem""")
def missing_filled(spark, sf):
    rows = table(spark, sf, "lineitem")
    rows = rows.select(
        *LINE_KEYS, F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("gappy"),
        F.when(F.col("l_tax") == 0.02, F.lit(math.nan)).otherwise(F.col("l_tax")).alias("nan_gaps"),
        F.when(F.col("l_returnflag") != "A", F.col("l_linestatus") == "O").alias("flag"),
        F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("word"),
    )
    return select.FillMissing()(select.MissingFeatures(("gappy", "absent_feature"))(rows))


@query(f"""
SELECT {LINE}, CASE WHEN l_tax = 0 THEN 65504 WHEN l_tax = 0.01 THEN 0 ELSE l_tax END::DOUBLE AS odd FROM lineitem""")
def finite_values(spark, sf):
    tax = F.col("l_tax")
    rows = table(spark, sf, "lineitem").withColumn(
        "odd", F.when(tax == 0, F.lit(math.inf)).when(tax == 0.01, F.lit(math.nan)).otherwise(tax))
    return select.Finite(("odd",))(rows).select(*LINE_KEYS, "odd")


@query("SELECT s_suppkey, s_name, CAST(7 AS DOUBLE) AS s_nationkey, CAST(1.5 AS DOUBLE) AS s_acctbal FROM supplier")
def constants_by_name(spark, sf):
    return select.SetByName({"nation": 7.0, "acct": 1.5})(table(spark, sf, "supplier"))


FLAGS_SQL = """
WITH f AS (SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS goal_type_a, (o_orderpriority = '2-HIGH')::INT AS goal_type_b,
                  (o_orderstatus = 'F')::INT AS os_targets_x, (o_orderstatus = 'O')::INT AS os_targets_y FROM orders)
SELECT o_orderkey, CASE WHEN goal_type_a + goal_type_b = 0 THEN 1 ELSE goal_type_a END AS goal_type_a,
       CASE WHEN goal_type_a + goal_type_b = 0 THEN 1 ELSE goal_type_b END AS goal_type_b, """


def flagged_orders(spark, sf):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        "o_orderkey", (priority == "1-URGENT").cast("int").alias("goal_type_a"),
        (priority == "2-HIGH").cast("int").alias("goal_type_b"),
        (status == "F").cast("int").alias("os_targets_x"), (status == "O").cast("int").alias("os_targets_y"),
    )


@query(FLAGS_SQL + "os_targets_x, os_targets_y FROM f")
def empty_group_switched_on(spark, sf):
    return select.FillEmptyGroup(("goal_type_a", "goal_type_b"))(flagged_orders(spark, sf))


@query(FLAGS_SQL + """CASE WHEN os_targets_x + os_targets_y = 0 THEN 1 ELSE os_targets_x END AS os_targets_x,
       CASE WHEN os_targets_x + os_targets_y = 0 THEN 1 ELSE os_targets_y END AS os_targets_y FROM f""")
def empty_groups_switched_on(spark, sf):
    return select.FillEmptyGroups(("goal_type_", "os_targets_", "language_"))(flagged_orders(spark, sf))


@query("SELECT o_orderkey, o_orderstatus = 'P' OR o_custkey = 0 AS tabular FROM orders")
def routed_rows(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", select.route({"o_orderstatus": "P", "o_custkey": 0}).alias("tabular"))


@query("""
SELECT p_partkey, list_contains(string_split(p_name, ' '), 'ring') AS has_ring, FALSE AS not_a_list FROM part""")
def list_membership(spark, sf):
    rows = table(spark, sf, "part").withColumn("words", F.split("p_name", " "))
    return rows.select("p_partkey", select.holds_item(rows, "words", "ring").alias("has_ring"),
                       select.holds_item(rows, "p_brand", "ring").alias("not_a_list"))


@query("""
WITH s AS (SELECT stddev_samp(value) AS s FROM events),
     t AS (SELECT 0.1::DOUBLE + k * 0.1::DOUBLE AS m FROM range(0, 200) r(k)),
     ok AS (SELECT min(m) AS m FROM t, s WHERE (SELECT avg((value > m * s)::INT) FROM events) <= 0.5)
SELECT event_id, value > m * s AS outlier FROM events, s, ok""")
def outlier_flags(spark, sf):
    return select.OutlierRule("value", threshold=0.1).fit_transform(table(spark, sf, "events")).select("event_id", "outlier")


@query("SELECT p_partkey, 'film_' || p_partkey || '.mp4' AS files FROM part")
def playable_videos(spark, sf):
    key = F.col("p_partkey").cast("string")
    rows = table(spark, sf, "part").select("p_partkey", F.array(
        F.concat(F.lit("film_"), key, F.lit(".mp4")), F.concat(F.lit("film"), key, F.lit("_800_1200_756k.mp4")),
    ).alias("files"))
    return select.PlayableVideos(("files",))(rows).select("p_partkey", text_list("files").alias("files"))


@query("""
SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'listed' ELSE 'rest' END AS part,
       CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def rows_by_id_list(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    ids = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    listed = select.only_ids(orders, ids, ["c_custkey"]).withColumn("part", F.lit("listed"))
    rest = select.except_ids(orders, ids, ["c_custkey"]).withColumn("part", F.lit("rest"))
    return listed.unionByName(rest).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS keys, TRUE AS near_four_fifths FROM orders")
def stable_split(spark, sf):
    """Each row is on one side, and about four fifths are training rows."""
    marked = select.mark_split(table(spark, sf, "orders"), ["o_orderkey"])
    sides = marked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    share = F.max(F.when(F.col("split") == "train", F.col("n"))) / F.sum("n")
    return sides.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), F.abs(share - 0.8).try_cast("double").alias("off")).select(
        "n", "keys", (F.col("off") < 0.05).alias("near_four_fifths"))
