"""Joins, group aggregates, time grids, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.catalog.registry import query, rounded, table, text_list
from loomwright.operators import aggregate as agg
from loomwright.operators import features, lookup
from loomwright.operators.encode import Codes, OneHot
from loomwright.operators.spine import TimeGrid
from loomwright.plans.joins import salted_join
from loomwright.sources import files

FIRST_LINE = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus"
FIRST_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")


@query(f"""
SELECT l_suppkey, round(avg((l_returnflag = 'R')::INT), 6) AS returned, first(l_returnflag {FIRST_LINE}) AS l_returnflag,
       first(l_linestatus {FIRST_LINE}) AS l_linestatus, round(avg(l_quantity), 6) AS l_quantity,
       round(sum(l_extendedprice), 2) AS l_extendedprice, round(ln(1 + sum(l_extendedprice)), 6) AS log_l_extendedprice,
       round(ln(1 + avg(l_quantity)), 6) AS log_l_quantity, max(l_tax) AS l_tax, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_suppkey""")
def typed_group_rows(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({
        "returned": F.col("l_returnflag") == "R", "log_l_extendedprice": F.log1p("l_extendedprice"),
        "log_l_quantity": F.log1p("l_quantity"),
    })
    step = agg.GroupRows(
        ("l_suppkey",),
        ("returned", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "log_l_extendedprice",
         "log_l_quantity", "l_tax"),
        by_column={"l_extendedprice": "sum", "log_l_extendedprice": "sum", "l_tax": F.max},
        order_by=FIRST_KEYS, count_column="n",
    )
    done = step(rows)
    return done.select(
        "l_suppkey", rounded("returned").alias("returned"), "l_returnflag", "l_linestatus",
        rounded("l_quantity").alias("l_quantity"), rounded("l_extendedprice", 2).alias("l_extendedprice"),
        rounded("log_l_extendedprice").alias("log_l_extendedprice"), rounded("log_l_quantity").alias("log_l_quantity"),
        "l_tax", "n",
    )


@query("SELECT o_orderkey, o_custkey, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS o_custkey_len FROM orders")
def group_count_on_rows(spark, sf):
    return agg.GroupValue(("o_custkey",))(table(spark, sf, "orders")).select("o_orderkey", "o_custkey", "o_custkey_len")


@query("""
SELECT o_orderkey, round(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 2) AS reach
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus)""")
def group_function_on_rows(spark, sf):
    step = agg.GroupValue(
        ("o_custkey", "o_orderstatus"), lambda: F.max("o_totalprice") - F.min("o_totalprice"), alias="reach")
    return step(table(spark, sf, "orders")).select("o_orderkey", rounded("reach", 2).alias("reach"))


@query("""
WITH f AS (SELECT o_custkey, arg_min(o_orderdate, o_orderkey) AS d FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o_custkey, dayname(d) AS weekday FROM orders JOIN f USING (o_custkey)""")
def first_row_of_group(spark, sf):
    step = agg.OncePerGroup(("o_custkey",), features.WeekdayName(("o_orderdate",)), ("o_orderdate",), ("o_orderkey",))
    return step(table(spark, sf, "orders")).select("o_orderkey", "o_custkey", "weekday")


@query("SELECT o_custkey, CAST(count(o_totalprice) AS BIGINT) AS n FROM orders GROUP BY o_custkey")
def group_counts(spark, sf):
    return agg.group_counts(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice")


@query("SELECT DISTINCT o_orderpriority AS value FROM orders")
def distinct_values(spark, sf):
    return agg.distinct_values(table(spark, sf, "orders"), "o_orderpriority")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS value FROM part")
def distinct_items(spark, sf):
    return agg.distinct_items(table(spark, sf, "part").select(F.split("p_name", " ").alias("words")), "words")


@query("""
SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(var_pop(l_quantity), 6) AS var_l_quantity,
       round(avg(l_discount), 6) AS mean_l_discount, round(var_pop(l_discount), 6) AS var_l_discount FROM lineitem""")
def feature_moments(spark, sf):
    done = agg.feature_moments(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    return done.select(*[rounded(c).alias(c) for c in done.columns])


@query("""
SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_l_quantity, round(var_pop(l_quantity), 6) AS var_l_quantity
FROM lineitem GROUP BY l_suppkey""")
def feature_moments_by_group(spark, sf):
    done = agg.feature_moments(table(spark, sf, "lineitem"), ["l_quantity"], ["l_suppkey"])
    return done.select("l_suppkey", *[rounded(c).alias(c) for c in done.columns if c != "l_suppkey"])


WORDS = "(SELECT p_partkey, p_size, p_retailprice, unnest(list_distinct(string_split(p_name, ' '))) AS item FROM part)"
ITEMS = "(SELECT DISTINCT split_part(p_name, ' ', 1) AS item FROM part UNION SELECT 'unheard')"


def worded_parts(spark, sf):
    rows = table(spark, sf, "part").withColumn("words", F.split("p_name", " ")).drop("p_name", "p_brand", "p_type")
    items = table(spark, sf, "part").select(F.split("p_name", " ")[0].alias("item")).distinct()
    return rows, items.unionByName(spark.createDataFrame([("unheard",)], "item string"))


@query(f"""
SELECT i.item, round(avg(w.p_size), 6) AS size, CAST(max(w.p_size) AS INTEGER) AS largest
FROM {ITEMS} i LEFT JOIN {WORDS} w USING (item) GROUP BY i.item""")
def values_per_item(spark, sf):
    rows, items = worded_parts(spark, sf)
    done = agg.per_item(rows, "words", {"size": F.avg("p_size"), "largest": F.max("p_size")}, items)
    return done.select("item", rounded("size").alias("size"), "largest")


@query(f"""
WITH s AS (SELECT i.item, coalesce(sum(w.p_size), 0) AS a, coalesce(sum(w.p_retailprice), 0) AS b
           FROM {ITEMS} i LEFT JOIN {WORDS} w USING (item) GROUP BY i.item)
SELECT item, round(a / sum(a) OVER (), 6) AS p_size_distro, round(b / sum(b) OVER (), 6) AS p_retailprice_distro FROM s""")
def share_per_item(spark, sf):
    rows, items = worded_parts(spark, sf)
    done = agg.item_shares(rows, "words", ["p_size", "p_retailprice"], items)
    return done.select("item", *[rounded(c).alias(c) for c in ("p_size_distro", "p_retailprice_distro")])


@query(f"""
SELECT i.item, round(avg((w.p_retailprice - 950) / 950), 6) + 0.0 AS p_retailprice_distro
FROM {ITEMS} i LEFT JOIN {WORDS} w USING (item) GROUP BY i.item""")
def rate_per_item(spark, sf):
    rows, items = worded_parts(spark, sf)
    done = agg.item_rates(rows, "words", "p_retailprice", items, 950)
    return done.select("item", rounded("p_retailprice_distro").alias("p_retailprice_distro"))


@query("""
WITH b AS (SELECT l_returnflag, CASE WHEN l_extendedprice BETWEEN 5000 AND 90000
                  THEN least(floor((l_extendedprice - 5000) / 85000 * 12), 11) END AS bin FROM lineitem),
     c AS (SELECT l_returnflag, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT * FROM (SELECT l_returnflag, CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS n,
                      round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS p FROM c) WHERE bin IS NOT NULL""")
def histogram_shares(spark, sf):
    done = agg.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 12, 5000.0, 90000.0, ["l_returnflag"])
    return done.withColumn("p", rounded("p"))


@query("""
WITH f AS (SELECT abs(avg(o_totalprice)) AS m, abs(stddev_pop(o_totalprice)) AS v FROM orders)
SELECT round(m, 3) AS m, round(v, 3) AS v, round(m - 1.5 * (v + m), 3) AS low, round(m + 1.5 * (v + m), 3) AS high FROM f""")
def search_range(spark, sf):
    done = agg.search_range(table(spark, sf, "orders"), "o_totalprice")
    return done.select(*[rounded(c, 3).alias(c) for c in done.columns])


IMPORTANCE = {"terms": ["l_discount", "l_tax"], "amount": ["l_quantity"]}


@query("""
SELECT 'terms' AS feature, round(abs(corr(l_discount, l_extendedprice)) + abs(corr(l_tax, l_extendedprice)), 6) AS importance FROM lineitem
UNION ALL SELECT 'amount', round(abs(corr(l_quantity, l_extendedprice)), 6) FROM lineitem
UNION ALL SELECT 'l_linenumber', round(corr(l_linenumber, l_extendedprice), 6) + 0.0 FROM lineitem""")
def grouped_importance(spark, sf):
    names = ["l_discount", "l_tax", "l_quantity", "l_linenumber"]
    row = table(spark, sf, "lineitem").agg(*[F.corr(c, "l_extendedprice").alias(c) for c in names])
    long = row.unpivot([], names, "feature", "importance")
    done = agg.grouped_importance(long, IMPORTANCE)
    return done.select("feature", rounded("importance").alias("importance"))


@query("""
SELECT 'terms' AS feature, round(-900 * (avg(l_discount) - 0.04) + 400 * (avg(l_tax) - 0.05), 6) + 0.0 AS importance FROM lineitem
UNION ALL SELECT 'amount', round(1500 * (avg(l_quantity) - 20), 6) + 0.0 FROM lineitem
UNION ALL SELECT 'l_linenumber', round(30 * (avg(l_linenumber) - 3), 6) + 0.0 FROM lineitem""")
def grouped_effects(spark, sf):
    from loomwright.operators.models import LinearRegressor

    model = LinearRegressor(
        ("l_discount", "l_tax", "l_quantity", "l_linenumber"), ("l_extendedprice",),
        weights={"l_extendedprice": [-900.0, 400.0, 1500.0, 30.0]}, intercepts={"l_extendedprice": 0.0},
        mean={"l_discount": 0.04, "l_tax": 0.05, "l_quantity": 20.0, "l_linenumber": 3.0},
    )
    effects = model.contributions(table(spark, sf, "lineitem"), "l_extendedprice")
    done = agg.grouped_importance(effects, IMPORTANCE, absolute=False)
    return done.select("feature", rounded("importance").alias("importance"))


@query("""
WITH d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS ts, CAST(count(*) AS BIGINT) AS reach FROM events GROUP BY 1, 2)
SELECT event_id, e.user_id, date_trunc('day', e.ts)::TIMESTAMP AS ts, value, reach
FROM events e JOIN d ON d.user_id = e.user_id AND d.ts = date_trunc('day', e.ts)::TIMESTAMP""")
def columns_added_by_day(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    reach = rows.groupBy("user_id", day.alias("ts")).agg(
        F.count(F.lit(1)).alias("reach"), F.max("value").alias("value"))
    return lookup.add_columns(rows, reach, ["user_id", "ts"], "ts", "date")


CODED = """
WITH coded AS (SELECT c_custkey, left(r_name, 2) AS code, c_nationkey AS k FROM customer
               JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
     lists AS (SELECT c_custkey, [code || k, 'null', 'ZZ' || k, code || (k + 5) % 25] AS ids FROM coded)
"""


def coded_customers(spark, sf):
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reference = nation.select(
        F.col("n_nationkey").alias("id"), F.substring("r_name", 1, 2).alias("country_code"), F.col("n_name").alias("name"))
    rows = table(spark, sf, "customer").join(reference, F.col("c_nationkey") == F.col("id"))
    code, key = F.col("country_code"), F.col("id").cast("string")
    lists = rows.select("c_custkey", F.array(
        F.concat(code, key), F.lit("null"), F.concat(F.lit("ZZ"), key),
        F.concat(code, ((F.col("id") + 5) % 25).cast("string"))).alias("x_region"))
    return lists, reference


@query(CODED + """
, u AS (SELECT c_custkey, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM lists),
  n AS (SELECT left(r_name, 2) || n_nationkey AS x, n_name || ', ' || left(r_name, 2) AS v FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, string_agg(coalesce(v, '~'), '|' ORDER BY i) AS x_region_name
FROM u LEFT JOIN n USING (x) WHERE x <> 'null' GROUP BY c_custkey""")
def decoded_regions(spark, sf):
    rows, reference = coded_customers(spark, sf)
    done = lookup.DecodeRegions("_region", reference).fit_transform(rows)
    return done.select("c_custkey", text_list("x_region_name").alias("x_region_name"))


@query("""
WITH u AS (SELECT c_custkey, c_nationkey AS id, 1 AS i FROM customer UNION ALL SELECT c_custkey, (c_nationkey + 1) % 25, 2 FROM customer
           UNION ALL SELECT c_custkey, c_nationkey, 3 FROM customer)
SELECT c_custkey, string_agg(v, '|' ORDER BY i) AS ids_name FROM (
  SELECT c_custkey, trim(regexp_replace(n_name, '^NATION_', '')) AS v, min(i) AS i FROM u JOIN nation ON n_nationkey = id GROUP BY 1, 2)
GROUP BY c_custkey""")
def decoded_ids(spark, sf):
    key = F.col("c_nationkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.array(
        key.cast("string"), F.lit("--"), ((key + 1) % 25).cast("string"), F.lit("null"), F.lit(None).cast("string"),
        F.lit("999"), key.cast("string")).alias("ids"))
    reference = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    done = lookup.DecodeIds("ids", reference, strip="^NATION_").fit_transform(rows)
    return done.select("c_custkey", text_list("ids_name").alias("ids_name"))


@query("""
WITH u AS (SELECT o_orderkey, o_custkey AS id, 1 AS i FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, 2 FROM orders
           UNION ALL SELECT o_orderkey, o_custkey * 7, 3 FROM orders),
     d AS (SELECT o_orderkey, c_name AS v, min(i) AS i FROM u JOIN customer ON c_custkey = id GROUP BY 1, 2)
SELECT o_orderkey, string_agg(v, '|' ORDER BY i) AS ids_name FROM d GROUP BY o_orderkey""")
def decoded_ids_large_table(spark, sf):
    key = F.col("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.array(
        *[k.cast("string") for k in (key, key + 1, key * 7)]).alias("ids"))
    reference = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    # not fitted: the table counts as too long for a literal map and is joined
    done = lookup.DecodeIds("ids", reference)(rows)
    return done.select("o_orderkey", text_list("ids_name").alias("ids_name"))


LARGE_CODED = """
WITH ref AS (SELECT left(r_name, 2) || c_custkey AS x, c_name || ', ' || left(r_name, 2) AS v, c_custkey AS id
             FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
     l AS (SELECT o_orderkey, [x, 'null', 'ZZ1', 'plain', x] AS ids FROM orders JOIN ref ON id = o_custkey),
     u AS (SELECT o_orderkey, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM l)
SELECT o_orderkey, string_agg(CASE WHEN x = 'plain' THEN x ELSE coalesce(v, '~') END, '|' ORDER BY i) AS x_region_name
FROM u LEFT JOIN ref USING (x) WHERE x <> 'null' GROUP BY o_orderkey"""


def large_coded(spark, sf):
    """Orders with lists of coded customers, and the table of all customers as the reference."""
    areas = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reference = table(spark, sf, "customer").join(areas, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.substring("r_name", 1, 2).alias("country_code"), F.col("c_name").alias("name"))
    code = F.concat("country_code", F.col("id").cast("string"))
    rows = table(spark, sf, "orders").join(reference, F.col("o_custkey") == F.col("id")).select(
        "o_orderkey", F.array(code, F.lit("null"), F.lit("ZZ1"), F.lit("plain"), code).alias("x_region"))
    return rows, reference


@query(LARGE_CODED)
def decoded_regions_large_table(spark, sf):
    rows, reference = large_coded(spark, sf)
    # not fitted: the table counts as too long for a literal map and is joined
    done = lookup.DecodeRegions("_region", reference)(rows)
    return done.select("o_orderkey", text_list("x_region_name").alias("x_region_name"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 11 > 0 THEN 'C' || o_custkey END AS name FROM orders)
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS o_custkey_index,
       CASE WHEN name IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY name NULLS LAST) - 1 AS BIGINT) END AS name_index FROM r""")
def dictionary_codes(spark, sf):
    """Codes of columns with thousands of values, by joins."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("name"))
    return Codes(("o_custkey", "name")).fit_transform(rows).select("o_orderkey", "o_custkey_index", "name_index")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN []
                  ELSE [o_custkey, (o_custkey * 7) % 5003, NULL, o_custkey, o_orderkey % 3001] END AS l FROM orders),
     u AS (SELECT DISTINCT o_orderkey, x FROM (SELECT o_orderkey, unnest(l) AS x FROM r) WHERE x IS NOT NULL),
     d AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT x FROM u)),
     g AS (SELECT o_orderkey, string_agg(i, '|' ORDER BY i) AS l FROM u JOIN d USING (x) GROUP BY 1)
SELECT o_orderkey, CASE WHEN r.l IS NOT NULL THEN coalesce(g.l, '') END AS l_indices FROM r LEFT JOIN g USING (o_orderkey)""")
def sparse_multi_hot(spark, sf):
    """List elements as sorted places in a dictionary of thousands."""
    key, other = F.col("o_custkey"), F.col("o_orderkey")
    full = F.array(key, (key * 7) % 5003, F.lit(None).cast("bigint"), key, other % 3001)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(other % 9 > 1, full).when(other % 9 == 1, F.array().cast("array<bigint>")).alias("l"))
    return Codes(("l",)).fit_transform(rows).select("o_orderkey", text_list("l_indices").alias("l_indices"))


@query("""
SELECT p_partkey, 1 AS flags, CAST(dense_rank() OVER (ORDER BY p_partkey % 1301) - 1 AS BIGINT) AS place FROM part""")
def one_hot_of_many_values(spark, sf):
    """More than a thousand flags: one is set, in the value's place."""
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 1301).alias("k"))
    done = OneHot(("k",)).fit_transform(rows)
    flags = F.array(*[F.col(c) for c in done.columns if c.startswith("k_")])
    return done.select("p_partkey", flags.alias("f")).select(
        "p_partkey", F.size(F.filter("f", lambda x: x)).alias("flags"), (F.array_position("f", True) - 1).alias("place"))


@query("""
WITH n AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS i FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CAST(n.i AS INTEGER) AS customer, CASE WHEN o_orderkey % 1000 < 900 THEN 'v' || (o_orderkey % 1000) * 7 % 1000 END AS lot,
       n.i || '|' || n.i AS pair
FROM orders JOIN n USING (o_custkey)""")
def value_map_of_many(spark, sf):
    """Maps of hundreds and thousands of values are joined: made from the data, given, and for list elements."""
    given = {k: f"v{k * 7 % 1000}" for k in range(900)}
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("customer"), (F.col("o_orderkey") % 1000).alias("lot"), F.array("o_custkey", "o_custkey").alias("pair"))
    done = lookup.MapValues(("customer", "lot", "pair"), {"lot": given}).fit_transform(rows)
    return done.select("o_orderkey", "customer", "lot", text_list("pair").alias("pair"))


COUNTRIES = """
WITH first AS (SELECT c_mktsegment AS profile_id, arg_min(c_nationkey, c_custkey) AS k FROM customer GROUP BY 1),
     named AS (SELECT DISTINCT profile_id, r_name FROM first JOIN nation ON n_nationkey IN (k, (k + 1) % 25, (k + 7) % 25)
               JOIN region ON r_regionkey = n_regionkey),
     countries AS (SELECT profile_id, string_agg(r_name, '|' ORDER BY r_name) AS region_country FROM named GROUP BY 1)
SELECT c_custkey, region_country, CASE WHEN c_custkey % 3 = 2 THEN 'GIVEN' ELSE region_country END AS country_targets
FROM customer JOIN countries ON profile_id = c_mktsegment"""


@query(COUNTRIES)
def countries_from_regions_by_join(spark, sf):
    return named_countries(spark, sf, fitted=False)


@query(COUNTRIES)
def countries_from_regions(spark, sf):
    return named_countries(spark, sf, fitted=True)


def named_countries(spark, sf, fitted):
    key = F.col("c_nationkey")
    name = lambda k: F.concat(F.lit("NATION_"), k.cast("string"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("profile_id"),
        F.array(name(key), name((key + 1) % 25), name((key + 7) % 25), F.lit("NOWHERE")).alias("region_targets"),
        F.when(F.col("c_custkey") % 3 == 1, F.array().cast("array<string>"))
        .when(F.col("c_custkey") % 3 == 2, F.array(F.lit("GIVEN"))).alias("country_targets"),
    )
    regions = table(spark, sf, "nation").select(
        F.col("n_name").alias("region"), F.col("n_regionkey").cast("string").alias("country_code"))
    countries = table(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("country"))
    step = lookup.CountriesFromRegions(
        "country_targets", "region_targets", "profile_id", ("c_custkey",), regions, countries)
    done = step.fit_transform(rows) if fitted else step(rows)
    return done.select("c_custkey", text_list("region_country").alias("region_country"),
                       text_list("country_targets").alias("country_targets"))


@query("""
WITH first AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1),
     codes AS (SELECT o_custkey, unnest([k % n, (k * 3) % n, -1]) AS code FROM first, (SELECT count(*) AS n FROM embeddings)),
     long AS (SELECT o_custkey, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i
              FROM codes JOIN embeddings ON vec_id = code),
     means AS (SELECT o_custkey, i, avg(v) AS v FROM long GROUP BY 1, 2),
     wide AS (SELECT o_custkey, sum(v) FILTER (i = 1) AS a, sum(v) FILTER (i = 64) AS b, sqrt(sum(v * v)) AS norm FROM means GROUP BY 1)
SELECT o_orderkey, round(a, 6) + 0.0 AS clip_0, round(b, 6) + 0.0 AS clip_63, round(norm, 6) AS norm
FROM orders LEFT JOIN wide USING (o_custkey)""")
def embedding_average_by_group(spark, sf):
    from loomwright.functions.arrays import norm

    key = F.col("o_orderkey")
    vectors = table(spark, sf, "embeddings").count()
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.array(key % vectors, (key * 3) % vectors, F.lit(-1).cast("bigint")).alias("targets"))
    step = lookup.AverageEmbeddings(("targets",), "o_custkey", table(spark, sf, "embeddings"), "vec_id", ("o_orderkey",))
    done = step(rows)
    vector = F.col("targets_clip")
    return done.select(
        "o_orderkey", rounded(F.get(vector, F.lit(0))).alias("clip_0"), rounded(F.get(vector, F.lit(63))).alias("clip_63"),
        F.when(vector.isNotNull(), rounded(norm(vector))).alias("norm"))


@query("""
WITH ends AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events),
     spine AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM ends),
     g AS (SELECT DISTINCT user_id, event_type FROM events),
     d AS (SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT g.user_id, g.event_type, s.ts, round(coalesce(value, 0), 2) AS value, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM g CROSS JOIN spine s LEFT JOIN d ON d.user_id = g.user_id AND d.event_type = g.event_type AND d.ts = s.ts""")
def daily_spine(spark, sf):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    daily = table(spark, sf, "events").groupBy("user_id", "event_type", day.alias("ts")).agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    done = TimeGrid("ts", ("user_id", "event_type")).fit_transform(daily)
    return done.select("user_id", "event_type", "ts", rounded("value", 2).alias("value"), "n")


@query("""
WITH ends AS (SELECT date_trunc('hour', min(ts))::TIMESTAMP AS a, max(ts)::TIMESTAMP AS b FROM events),
     spine AS (SELECT unnest(generate_series(a, b, INTERVAL 6 HOUR)) AS ts FROM ends),
     g AS (SELECT DISTINCT event_type FROM events),
     d AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts::TIMESTAMP, a) AS ts, value FROM events, ends)
SELECT g.event_type, s.ts, coalesce(value, 0) AS value FROM g CROSS JOIN spine s
LEFT JOIN d ON d.event_type = g.event_type AND d.ts = s.ts""")
def hourly_grid_of_rows(spark, sf):
    """Several rows may share a step; every row is moved back to its step."""
    rows = table(spark, sf, "events").select("event_type", "ts", "value")
    return TimeGrid("ts", ("event_type",), freq="6H", truncate=True).fit_transform(rows)


@query("""
WITH ends AS (SELECT date_trunc('minute', min(ts))::TIMESTAMP AS a, max(ts)::TIMESTAMP AS b FROM events),
     spine AS (SELECT unnest(generate_series(a, b, INTERVAL 5 MINUTE)) AS ts FROM ends),
     d AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP, a) AS ts, sum(value) AS value, count(*) AS n FROM events, ends GROUP BY 1)
SELECT 1 AS site, s.ts, round(coalesce(value, 0), 2) AS value, CAST(coalesce(n, 0) AS BIGINT) AS n FROM spine s LEFT JOIN d USING (ts)""")
def fine_grid_of_one_group(spark, sf):
    """One group with very many steps, which are made by many tasks."""
    rows = table(spark, sf, "events").select(F.lit(1).alias("site"), "ts", "value", F.lit(1).alias("n"))
    done = TimeGrid("ts", ("site",), freq="5T", truncate=True).fit_transform(rows)
    return done.groupBy("site", "ts").agg(rounded(F.sum("value"), 2).alias("value"), F.sum("n").alias("n"))


@query("""
WITH ends AS (SELECT date_trunc('quarter', min(o_orderdate))::TIMESTAMP AS a, max(o_orderdate)::TIMESTAMP AS b FROM orders),
     spine AS (SELECT unnest(generate_series(a, b, INTERVAL 3 MONTH)) AS day FROM ends),
     g AS (SELECT DISTINCT o_custkey FROM orders),
     d AS (SELECT o_custkey, date_trunc('quarter', o_orderdate)::TIMESTAMP AS day, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, day, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g CROSS JOIN spine LEFT JOIN d USING (o_custkey, day)""")
def quarterly_grid(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("day"), F.lit(1).alias("n"))
    done = TimeGrid("day", ("o_custkey",), freq="QS", truncate=True).fit_transform(rows)
    return done.groupBy("o_custkey", "day").agg(F.sum("n").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def validation_head(spark, sf):
    valid, _ = files.head_and_rest(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])
    return valid


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)")
def training_rest(spark, sf):
    _, rest = files.head_and_rest(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])
    return rest


@query("SELECT * FROM customer")
def shuffled_rows(spark, sf):
    return files.shuffled(table(spark, sf, "customer"), ["c_custkey"])


@query("""
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def stacked_frames(spark, sf):
    first = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    second = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return first.unionByName(second, allowMissingColumns=True)


@query("""
SELECT o_custkey, CAST(count(*) AS BIGINT) AS lines, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def revenue_by_customer(spark, sf):
    """Lines joined to their orders, slicing orders with very many lines."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    joined = salted_join(lines, table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "inner")
    return joined.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("lines"), rounded(F.sum("l_extendedprice"), 2).alias("revenue"))


@query("""
SELECT user_id, event_type, ts, value, dayname(ts) AS weekday, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS weekday_wave FROM (
WITH ends AS (SELECT date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events),
     spine AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM ends),
     g AS (SELECT DISTINCT user_id, event_type FROM events),
     d AS (SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS value FROM events GROUP BY 1, 2, 3)
SELECT g.user_id, g.event_type, s.ts, round(coalesce(value, 0), 2) AS value
FROM g CROSS JOIN spine s LEFT JOIN d ON d.user_id = g.user_id AND d.event_type = g.event_type AND d.ts = s.ts)""")
def calendar_features_on_grid(spark, sf):
    """A gap-free daily series per user and event type with weekday name and wave."""
    grid = daily_spine(spark, sf).drop("n")
    named = features.WeekdayName(("ts",))(grid)
    done = features.SineTime(("dayofweek",), {"dayofweek": 7}, "ts").fit_transform(named)
    return done.select("user_id", "event_type", "ts", "value", "weekday",
                       rounded("dayofweek_num_cont").alias("weekday_wave"))

