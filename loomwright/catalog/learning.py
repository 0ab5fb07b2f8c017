"""Models, routed prediction, recommendation and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.catalog.registry import query, rounded, table
from loomwright.operators import curves, models, scoring, search
from loomwright.operators.aggregate import GroupRows
from loomwright.operators.features import Factors, SignedLog
from loomwright.plans.operator import Chain

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"]
PRICE = ("l_extendedprice",)


@query("""
WITH m AS (SELECT var_pop(l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, var_pop(l_discount) AS c,
                  covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
                  avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem),
     w AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS w1, (a * q - b * p) / (a * c - b * b) AS w2 FROM m)
SELECT 'l_extendedprice' AS target, 'l_quantity' AS feature, round(w1, 4) AS weight FROM w
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(w2, 3) FROM w
UNION ALL SELECT 'l_extendedprice', '1', round(my - w1 * mx - w2 * mz, 3) FROM w""")
def linear_weights(spark, sf):
    model = models.LinearRegressor(("l_quantity", "l_discount"), PRICE).fit(table(spark, sf, "lineitem"))
    table_ = model.coefficients(spark)
    return table_.withColumn("weight", F.when(F.col("feature") == "l_quantity", rounded("weight", 4)).otherwise(rounded("weight", 3)))


@query(f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b,
                  regr_slope(l_tax, l_quantity) AS c, regr_intercept(l_tax, l_quantity) AS d FROM lineitem)
SELECT {LINE}, round(a * l_quantity + b, 3) AS pred_l_extendedprice, round(c * l_quantity + d, 6) AS pred_l_tax FROM lineitem, f""")
def linear_predictions(spark, sf):
    model = models.LinearRegressor(("l_quantity",), ("l_extendedprice", "l_tax"))
    done = model.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 3).alias("pred_l_extendedprice"),
                       rounded("pred_l_tax").alias("pred_l_tax"))


@query(f"""
WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT {LINE}, round(a * l_quantity + b, 3) AS pred_l_extendedprice FROM lineitem JOIN f USING (l_returnflag)""")
def grouped_predictions(spark, sf):
    model = models.GroupedRegressor(("l_quantity",), PRICE, "l_returnflag")
    done = model.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 3).alias("pred_l_extendedprice"))


@query(f"""
WITH f AS (SELECT l_returnflag, l_suppkey % 80 AS s, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2)
SELECT {LINE}, round(p, 2) AS pred_l_extendedprice FROM lineitem l JOIN f ON f.l_returnflag = l.l_returnflag AND s = l_suppkey % 80""")
def grouped_predictions_of_many_columns(spark, sf):
    """80 flags per group: the model of a group gives each flag's mean."""
    flags = tuple(f"s_{k}" for k in range(80))
    rows = table(spark, sf, "lineitem").withColumns({f: (F.col("l_suppkey") % 80 == k).cast("double") for k, f in enumerate(flags)})
    done = models.GroupedRegressor(flags, PRICE, "l_returnflag").fit_transform(rows)
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 2).alias("pred_l_extendedprice"))


@query("""
SELECT l_suppkey, round(regr_r2(l_extendedprice, l_quantity), 6) AS l_extendedprice, round(regr_r2(l_tax, l_quantity), 6) AS l_tax
FROM lineitem GROUP BY 1""")
def grouped_scores(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = models.GroupedRegressor(("l_quantity",), ("l_extendedprice", "l_tax"), "l_suppkey").fit(rows)
    done = model.score_table(rows)
    return done.select("l_suppkey", *[rounded(c).alias(c) for c in ("l_extendedprice", "l_tax")])


@query("""
WITH t AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'valid' END AS split FROM lineitem),
     f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
           FROM t WHERE split = 'train' GROUP BY 1)
SELECT l_returnflag, split, round(1 - sum(pow(l_extendedprice - a * l_quantity - b, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS l_extendedprice
FROM t JOIN f USING (l_returnflag) GROUP BY 1, 2""")
def grouped_training_scores(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "split", F.when(F.col("l_linestatus") == "F", "train").otherwise("valid"))
    _, scores = models.grouped_training(rows, "l_returnflag", ["l_quantity"], list(PRICE), "split")
    return scores.withColumn("l_extendedprice", rounded("l_extendedprice"))


@query(f"""
WITH f AS (SELECT l_returnflag, avg(l_quantity) AS m, var_pop(l_quantity) AS v,
                  sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * var_pop(l_extendedprice)) AS s FROM lineitem GROUP BY 1)
SELECT {LINE}, round(s * sqrt(1 + pow(m - l_quantity, 2) / v), 3) AS confidence FROM lineitem JOIN f USING (l_returnflag)""")
def grouped_confidence(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = models.GroupedRegressor(("l_quantity",), PRICE, "l_returnflag").fit(rows)
    return model.confident(rows, "l_extendedprice").select(*LINE_KEYS, rounded("confidence", 3).alias("confidence"))


@query(f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b,
                  regr_slope(l_extendedprice, l_tax) AS c, regr_intercept(l_extendedprice, l_tax) AS d FROM lineitem),
     z AS (SELECT *, a * l_quantity + b AS z1, c * l_tax + d AS z2 FROM lineitem, f),
     m AS (SELECT var_pop(z1) AS va, covar_pop(z1, z2) AS vb, var_pop(z2) AS vc, covar_pop(z1, l_extendedprice) AS p,
                  covar_pop(z2, l_extendedprice) AS q, avg(z1) AS mx, avg(z2) AS mz, avg(l_extendedprice) AS my FROM z),
     w AS (SELECT *, (vc * p - vb * q) / (va * vc - vb * vb) AS w1, (va * q - vb * p) / (va * vc - vb * vb) AS w2 FROM m)
SELECT {LINE}, round(my + w1 * (z1 - mx) + w2 * (z2 - mz), 2) AS pred_l_extendedprice FROM z, w""")
def stacked_predictions(spark, sf):
    bases = (models.LinearRegressor(("l_quantity",), PRICE), models.LinearRegressor(("l_tax",), PRICE))
    model = models.StackedRegressor(("l_quantity", "l_tax"), PRICE, bases)
    done = model.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 2).alias("pred_l_extendedprice"))


@query(f"""
WITH m AS (SELECT l_linenumber, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1)
SELECT {LINE}, round(p, 2) AS pred_l_extendedprice FROM lineitem JOIN m USING (l_linenumber)""")
def tree_predictions(spark, sf):
    """A tree deep enough to give every line number its own leaf."""
    from pyspark.ml.regression import DecisionTreeRegressor

    model = models.SparkRegressor(("l_linenumber",), PRICE, build=lambda: DecisionTreeRegressor(maxDepth=7, seed=42))
    done = model.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 2).alias("pred_l_extendedprice"))


@query()
def tree_importances(spark, sf):
    from pyspark.ml.regression import RandomForestRegressor

    from loomwright.operators.aggregate import grouped_importance

    features = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    model = models.SparkRegressor(
        features, PRICE, build=lambda: RandomForestRegressor(numTrees=5, maxDepth=4, seed=42))
    found = model.fit(table(spark, sf, "lineitem")).importances(spark, "l_extendedprice")
    return grouped_importance(found, {"terms": ["l_discount", "l_tax"]})


@query(f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem),
     g AS (SELECT *, l_discount * 5 + l_tax * 5 AS fac FROM lineitem, f)
SELECT {LINE}, round((a * l_quantity + b) * CASE WHEN fac > 0 THEN fac ELSE 1 END, 3) AS pred_l_extendedprice FROM g""")
def factored_predictions(spark, sf):
    factor = Factors(("l_discount", "l_tax"), (5.0, 5.0), normalize=False, suffix="_wfac")
    model = models.FactoredRegressor(("l_quantity",), PRICE, models.LinearRegressor(("l_quantity",), PRICE), (factor,))
    done = model.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 3).alias("pred_l_extendedprice"))


@query(f"""
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT {LINE}, round(a * l_quantity + b, 3) AS pred_l_extendedprice, CAST(0.5 AS DOUBLE) AS l_tax FROM lineitem, f""")
def defaulted_predictions(spark, sf):
    """A feature held constant while fitting carries no weight."""
    base = models.LinearRegressor(("l_quantity", "l_tax"), PRICE)
    model = models.DefaultedRegressor(("l_quantity", "l_tax"), PRICE, base, {"tax": 0.5})
    done = model.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, rounded("pred_l_extendedprice", 3).alias("pred_l_extendedprice"), "l_tax")


def fixed(features, targets, weights, intercepts):
    return models.LinearRegressor(features, targets, weights=weights, intercepts=intercepts)


@query("""
WITH g AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(q, 6) AS l_quantity,
       round(CASE WHEN l_suppkey = 7 THEN 1000 + 10 * d ELSE 500 + 1400 * q - 20 * d END * n, 3) AS l_extendedprice,
       round(CASE WHEN l_suppkey = 7 THEN exp(2 + d) - 1 ELSE exp(0.1 * q + d) - 1 END, 6) AS clicks
FROM g""")
def routed_prediction(spark, sf):
    """Rows averaged per supplier, supplier 7 scored by the second model, means scaled back to sums."""
    targets = ("l_extendedprice", "log_clicks")
    main = fixed(("l_quantity", "l_discount"), targets, {"l_extendedprice": [1400.0, -20.0], "log_clicks": [0.1, 1.0]},
                 {"l_extendedprice": 500.0, "log_clicks": 0.0})
    other = fixed(("l_discount",), targets, {"l_extendedprice": [10.0], "log_clicks": [1.0]},
                  {"l_extendedprice": 1000.0, "log_clicks": 2.0})
    grouping = GroupRows(("l_suppkey",), ("l_quantity", "l_discount", "l_extendedprice"))
    flow = scoring.RoutedPrediction(main, targets, Chain((grouping,)), other, criteria={"l_suppkey": 7})
    done = flow(table(spark, sf, "lineitem"))
    return done.select("l_suppkey", rounded("l_quantity").alias("l_quantity"),
                       rounded("l_extendedprice", 3).alias("l_extendedprice"), rounded("clicks").alias("clicks"))


@query("""
WITH g AS (SELECT l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS price, count(*) AS n FROM lineitem WHERE l_suppkey <> 7 GROUP BY 1)
SELECT l_suppkey, CAST(NULL AS BIGINT) AS l_orderkey, round((500 + 1400 * q) * n, 2) AS l_extendedprice FROM g
UNION ALL SELECT l_suppkey, l_orderkey, round(1000 + 10 * sign(l_quantity) * ln(1 + l_quantity), 2) FROM lineitem WHERE l_suppkey = 7""")
def routed_prediction_with_two_preparations(spark, sf):
    """Supplier 7 keeps its single rows, with logs; the others are averaged."""
    main = fixed(("l_quantity",), PRICE, {"l_extendedprice": [1400.0]}, {"l_extendedprice": 500.0})
    other = fixed(("l_quantity",), PRICE, {"l_extendedprice": [10.0]}, {"l_extendedprice": 1000.0})
    grouping = GroupRows(("l_suppkey",), ("l_quantity", "l_extendedprice"))
    flow = scoring.RoutedPrediction(
        main, PRICE, Chain((grouping,)), other, Chain((SignedLog(("l_quantity",)),)), criteria={"l_suppkey": 7})
    done = flow(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_quantity", "l_extendedprice"))
    return done.select("l_suppkey", "l_orderkey", rounded("l_extendedprice", 2).alias("l_extendedprice"))


@query("""
WITH t AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'valid' END AS split, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS flag FROM lineitem),
     f AS (SELECT regr_slope(l_extendedprice, flag) AS a, regr_intercept(l_extendedprice, flag) AS b FROM t WHERE split = 'train')
SELECT split, round(1 - sum(pow(l_extendedprice - a * flag - b, 2)) / (var_pop(l_extendedprice) * count(*)), 6) + 0.0 AS r2_l_extendedprice,
       round(avg(pow(l_extendedprice - a * flag - b, 2)), 1) AS mse_l_extendedprice FROM t, f GROUP BY split""")
def training_job(spark, sf):
    """Rows with neither flag get both, so one feature is left that varies."""
    rows = table(spark, sf, "lineitem").withColumns({
        "ad_types_a": (F.col("l_returnflag") == "R").cast("int"), "ad_types_b": (F.col("l_returnflag") == "A").cast("int")})
    model = models.LinearRegressor(("ad_types_a",), PRICE)
    trained = scoring.train(
        rows.where("l_linestatus = 'F'"), model, ["l_orderkey", "l_linenumber"], valid=rows.where("l_linestatus <> 'F'"))
    return trained.scores.select("split", rounded("r2_l_extendedprice").alias("r2_l_extendedprice"),
                                 rounded("mse_l_extendedprice", 1).alias("mse_l_extendedprice"))


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, 2 AS splits FROM lineitem""")
def training_job_with_own_split(spark, sf):
    """The job splits by key itself; every row is used on one side."""
    rows = table(spark, sf, "lineitem")
    model = models.LinearRegressor(("l_quantity", "l_discount"), PRICE)
    trained = scoring.train(rows, model, ["l_orderkey", "l_linenumber"])
    return trained.flow(rows).agg(F.count("l_extendedprice").alias("n")).join(
        trained.scores.agg(F.count(F.lit(1)).cast("int").alias("splits")))


def response_model():
    return fixed(("l_quantity", "l_discount", "l_tax"), PRICE, {"l_extendedprice": [1500.0, -2000.0, 700.0]}, {"l_extendedprice": 900.0})


CANDIDATE_SQL = """
c AS (SELECT i AS candidate, -0.4 + 0.8 * ((i * 37) % 101) / 101.0::DOUBLE AS cd, -0.4 + 0.8 * ((i * 53) % 97) / 97.0::DOUBLE AS ct FROM range(0, 60) r(i)),
m AS (SELECT candidate, cd, ct, avg(900 + 1500 * l_quantity - 2000 * cd + 700 * ct) AS mean FROM c, lineitem GROUP BY ALL)"""


def fixed_candidates(count=60):
    rows = tuple((-0.4 + 0.8 * ((i * 37) % 101) / 101.0, -0.4 + 0.8 * ((i * 53) % 97) / 97.0) for i in range(count))
    return search.Candidates(("l_discount", "l_tax"), rows)


@query("WITH " + CANDIDATE_SQL + "SELECT CAST(candidate AS INTEGER) AS candidate, round(mean, 3) AS mean, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS rows FROM m")
def mean_response_per_candidate(spark, sf):
    done = search.mean_responses(table(spark, sf, "lineitem"), response_model(), "l_extendedprice", fixed_candidates())
    return done.select("candidate", rounded("mean", 3).alias("mean"), "rows")


@query("WITH " + CANDIDATE_SQL + """,
s AS (SELECT candidate // 6 AS round, candidate, cd, ct, 1 / mean AS metric FROM m),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY round ORDER BY metric, candidate) = 1),
f AS (SELECT min(metric) AS best, avg(cd) AS md, avg(ct) AS mt, (SELECT var_pop(v) FROM (SELECT cd AS v FROM w UNION ALL SELECT ct FROM w)) AS var FROM w),
x AS (SELECT cd, ct, exp(-pow(best - metric, 2) / 0.05 - pow(md - cd, 2) / var) AS wd, exp(-pow(best - metric, 2) / 0.05 - pow(mt - ct, 2) / var) AS wt FROM w, f)
SELECT round(sum(wd * cd) / sum(wd), 6) + 0.0 AS l_discount, round(sum(wt * ct) / sum(wt), 6) + 0.0 AS l_tax FROM x""")
def recommended_values(spark, sf):
    done = search.recommend(
        table(spark, sf, "lineitem"), response_model(), "l_extendedprice", ["l_discount", "l_tax"], draws=6,
        candidates=fixed_candidates())
    return done.select(rounded("l_discount").alias("l_discount"), rounded("l_tax").alias("l_tax"))


SPACES = {"l_discount": (0.0, 0.3), "l_tax": (0.0, 0.2)}
DRAWN_SQL = ", ".join(f"({i}, {d!r}::DOUBLE, {t!r}::DOUBLE)" for i, (d, t) in enumerate(search.random_candidates(SPACES).rows))


@query("WITH c(candidate, cd, ct) AS (VALUES " + DRAWN_SQL + """),
f0 AS (SELECT avg(l_quantity) AS q FROM lineitem),
s AS (SELECT candidate // 25 AS round, candidate, cd, ct, 1 / (900 + 1500 * q - 2000 * cd + 700 * ct) AS metric FROM c, f0),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY round ORDER BY metric, candidate) = 1),
f AS (SELECT min(metric) AS best, avg(cd) AS md, avg(ct) AS mt, (SELECT var_pop(v) FROM (SELECT cd AS v FROM w UNION ALL SELECT ct FROM w)) AS var FROM w),
x AS (SELECT cd, ct, exp(-pow(best - metric, 2) / 0.05 - pow(md - cd, 2) / var) AS wd, exp(-pow(best - metric, 2) / 0.05 - pow(mt - ct, 2) / var) AS wt FROM w, f)
SELECT round(sum(wd * cd) / sum(wd), 6) + 0.0 AS l_discount, round(sum(wt * ct) / sum(wt), 6) + 0.0 AS l_tax FROM x""")
def recommended_from_random_draws(spark, sf):
    """80 rounds of 25 draws; the SQL twin holds the same draws as literals."""
    done = search.recommend(table(spark, sf, "lineitem"), response_model(), "l_extendedprice", SPACES)
    return done.select(rounded("l_discount").alias("l_discount"), rounded("l_tax").alias("l_tax"))


@query("WITH " + CANDIDATE_SQL + """
SELECT CAST(candidate AS INTEGER) AS candidate, round(cd, 6) + 0.0 AS l_discount, round(ct, 6) + 0.0 AS l_tax, round(mean, 3) AS mean,
       round((0.7 + 0.3 * (cd + ct) * (1 / cd + 1 / ct) / 4) / mean, 12) + 0.0 AS objective FROM m
ORDER BY (0.7 + 0.3 * (cd + ct) * (1 / cd + 1 / ct) / 4) / mean, candidate LIMIT 1""")
def recommended_by_objective(spark, sf):
    done = search.recommend_by_objective(
        table(spark, sf, "lineitem"), response_model(), "l_extendedprice", ["l_discount", "l_tax"],
        candidates=fixed_candidates())
    return done.select("candidate", rounded("l_discount").alias("l_discount"), rounded("l_tax").alias("l_tax"),
                       rounded("mean", 3).alias("mean"), rounded("objective", 12).alias("objective"))


TREE_ROWS = """
t AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS flag FROM lineitem),
leaf AS (SELECT l_linenumber AS k, flag, avg(l_extendedprice) AS v FROM t GROUP BY 1, 2),
side AS (SELECT flag, count(*) AS n FROM t GROUP BY 1)"""


def tree_model(spark, sf):
    """A tree deep enough to give every pair of line number and flag its own leaf, and its rows."""
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = table(spark, sf, "lineitem").withColumn("flag", (F.col("l_returnflag") == "A").cast("int"))
    model = models.SparkRegressor(("l_linenumber", "flag"), PRICE, build=lambda: DecisionTreeRegressor(maxDepth=14, seed=42))
    return model.fit(rows), rows


@query("WITH " + TREE_ROWS + """,
c AS (SELECT i AS candidate, 0.6 + 7.0 * ((i * 37) % 1999) / 1999.0::DOUBLE AS x FROM range(0, 2000) r(i))
SELECT CAST(candidate AS INTEGER) AS candidate, round(sum(v * n) / sum(n), 3) AS mean, round(sum(v * v * n) / sum(n), 0) AS square, CAST(sum(n) AS BIGINT) AS rows
FROM c JOIN leaf ON k = least(7, greatest(1, ceil(x - 0.5))) JOIN side USING (flag) GROUP BY candidate""")
def mean_response_of_tree(spark, sf):
    """2,000 candidates for a tree in one pass over the rows."""
    model, rows = tree_model(spark, sf)
    tried = tuple((0.6 + 7.0 * ((i * 37) % 1999) / 1999.0,) for i in range(2000))
    done = search.mean_responses(rows, model, "l_extendedprice", search.Candidates(("l_linenumber",), tried))
    return done.select("candidate", rounded("mean", 3).alias("mean"), rounded("square", 0).alias("square"), "rows")


@query("WITH " + TREE_ROWS + """,
o AS (SELECT unnest([0, 1]) AS flag),
p AS (SELECT v, count(*) AS n FROM t JOIN leaf ON k = l_linenumber JOIN o ON o.flag = leaf.flag GROUP BY v)
SELECT 'flag' AS field, 'l_extendedprice' AS target, CAST(2 AS BIGINT) AS combinations, round(sum(v * n) / sum(n), 3) AS mean,
       round(sqrt(sum(v * v * n) / sum(n) - pow(sum(v * n) / sum(n), 2)), 3) AS std FROM p""")
def response_of_tree_by_option(spark, sf):
    model, rows = tree_model(spark, sf)
    done = search.analyze_options(rows.select("l_linenumber", "flag"), model, {"flag": [0, 1]})
    return done.select("field", "target", "combinations", rounded("mean", 3).alias("mean"), rounded("std", 3).alias("std"))


TREE_SPACE = {"l_linenumber": (0.6, 7.4)}
TREE_DRAWS = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, (x,) in enumerate(search.random_candidates(TREE_SPACE).rows))


@query("WITH " + TREE_ROWS + ", c(candidate, x) AS (VALUES " + TREE_DRAWS + """),
m AS (SELECT candidate, x, sum(v * n) / sum(n) AS mean FROM c JOIN leaf ON k = least(7, greatest(1, ceil(x - 0.5))) JOIN side USING (flag) GROUP BY 1, 2),
s AS (SELECT candidate // 25 AS round, candidate, x, 1 / round(mean, 6) AS metric FROM m),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY round ORDER BY metric, candidate) = 1),
f AS (SELECT min(metric) AS best, avg(x) AS mx, var_pop(x) AS var FROM w),
g AS (SELECT x, exp(-pow(best - metric, 2) / 0.05 - pow(mx - x, 2) / var) AS wx FROM w, f)
SELECT round(sum(wx * x) / sum(wx), 4) + 0.0 AS l_linenumber FROM g""")
def recommended_values_of_tree(spark, sf):
    """Means are compared after rounding, since a leaf's draws tie."""
    model, rows = tree_model(spark, sf)
    draws = search.random_candidates(TREE_SPACE)
    responses = search.mean_responses(rows, model, "l_extendedprice", draws).withColumn("mean", rounded("mean"))
    winners = search.best_of_rounds(responses).join(draws.table(spark), "candidate")
    return search.weighted_winners(winners, draws.columns).select(rounded("l_linenumber", 4).alias("l_linenumber"))


EVEN_SQL = ", ".join(f"({i}, {d!r}::DOUBLE, {t!r}::DOUBLE)" for i, (d, t) in enumerate(search.even_candidates(SPACES).rows))


@query("WITH c(candidate, cd, ct) AS (VALUES " + EVEN_SQL + """),
m AS (SELECT candidate, cd, ct, avg(exp(0.02 * l_quantity + 1.5 * cd - 0.7 * ct + 0.5) - 1) AS mean FROM c, lineitem GROUP BY ALL)
SELECT CAST(candidate AS INTEGER) AS candidate, round(cd, 6) AS l_discount, round(ct, 6) AS l_tax, round(mean, 6) AS mean FROM m
ORDER BY (0.7 + 0.3 * (cd + ct) * (1 / cd + 1 / ct) / 4) / mean, candidate LIMIT 1""")
def recommended_by_even_candidates(spark, sf):
    """Evenly filling settings for a model on a log scale."""
    model = fixed(("l_quantity", "l_discount", "l_tax"), PRICE, {"l_extendedprice": [0.02, 1.5, -0.7]}, {"l_extendedprice": 0.5})
    done = search.recommend_by_objective(
        table(spark, sf, "lineitem"), model, "l_extendedprice", ["l_discount", "l_tax"], SPACES, logged=True)
    return done.select("candidate", rounded("l_discount").alias("l_discount"), rounded("l_tax").alias("l_tax"), rounded("mean").alias("mean"))


@query("WITH " + CANDIDATE_SQL.split("m AS")[0].rstrip().rstrip(",") + """
SELECT CAST(candidate AS INTEGER) AS candidate, round(avg(900 + 1500 * sign(l_quantity) * ln(1 + abs(l_quantity)) - 2000 * sign(cd) * ln(1 + abs(cd)) + 700 * ct), 3) AS mean,
       CAST(count(*) AS BIGINT) AS rows FROM c, lineitem GROUP BY candidate""")
def mean_response_through_steps(spark, sf):
    """A step that reads a replaced column runs for every candidate, in the same pass."""
    chain = Chain((SignedLog(("l_quantity",)), SignedLog(("l_discount",))))
    done = search.mean_responses(table(spark, sf, "lineitem"), response_model(), "l_extendedprice", fixed_candidates(), prepare=chain)
    return done.select("candidate", rounded("mean", 3).alias("mean"), "rows")


@query("""
WITH c AS (SELECT i AS candidate, i / 10.0::DOUBLE AS x FROM range(0, 5) r(i)),
     g AS (SELECT l_orderkey, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(candidate AS INTEGER) AS candidate, round(avg(900 + 1500 * q - 2000 * x * n), 3) AS mean, CAST(count(*) AS BIGINT) AS rows
FROM c, g GROUP BY candidate""")
def mean_response_behind_grouping(spark, sf):
    """The grouping sums the replaced column, so it has to see every candidate's value."""
    grouping = GroupRows(("l_orderkey",), ("l_quantity", "l_discount"), by_column={"l_discount": "sum"})
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    tried = search.Candidates(("l_discount",), tuple((i / 10.0,) for i in range(5)))
    model = fixed(("l_quantity", "l_discount"), PRICE, {"l_extendedprice": [1500.0, -2000.0]}, {"l_extendedprice": 900.0})
    done = search.mean_responses(rows, model, "l_extendedprice", tried, prepare=Chain((grouping,)))
    return done.select("candidate", rounded("mean", 3).alias("mean"), "rows")


def flag_model(targets=("clicks",), logged=False):
    features = ("l_quantity", "os_a", "os_b", "weekday_0", "weekday_1", "weekday_2")
    weights = [0.02, 0.3, -0.2, 0.5, 0.1, 0.4] if logged else [20.0, 300.0, -200.0, 500.0, 100.0, 400.0]
    return fixed(features, targets, {t: weights for t in targets}, {t: 0.5 for t in targets})


def flagged_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", (F.col("l_returnflag") == "A").alias("os_a"), (F.col("l_returnflag") == "R").alias("os_b"),
        *[(F.col("l_linenumber") == k).cast("int").alias(f"weekday_{k}") for k in range(3)])


RESPONSES = """
WITH o AS (SELECT 0 AS v UNION ALL SELECT 1),
     a AS (SELECT 20 * l_quantity + 0.5 + 300 * x.v - 200 * y.v + 500 * (l_linenumber = 0)::INT + 100 * (l_linenumber = 1)::INT + 400 * (l_linenumber = 2)::INT AS p
           FROM lineitem, o x, o y),
     n AS (SELECT x.v AS a, y.v AS b, z.v AS c, nullif(x.v + y.v + z.v, 0) AS t FROM o x, o y, o z),
     b AS (SELECT 20 * l_quantity + 0.5 + 300 * (l_returnflag = 'A')::INT - 200 * (l_returnflag = 'R')::INT
                  + coalesce(500 * a / t, 0) + coalesce(100 * b / t, 0) + coalesce(400 * c / t, 0) AS p FROM lineitem, n)
SELECT 'os' AS field, 'clicks' AS target, CAST(4 AS BIGINT) AS combinations, round(var_pop(p), 2) AS var, round(stddev_pop(p), 4) AS std, round(avg(p), 4) AS mean FROM a
UNION ALL SELECT 'weekday', 'clicks', CAST(8 AS BIGINT), round(var_pop(p), 2), round(stddev_pop(p), 4), round(avg(p), 4) FROM b"""


@query(RESPONSES)
def response_by_option(spark, sf):
    done = search.analyze_options(
        flagged_lines(spark, sf), flag_model(), {"os_": [True, False], "weekday_": [0, 1]}, normalized=("weekday_",))
    return done.select("field", "target", "combinations", rounded("var", 2).alias("var"), rounded("std", 4).alias("std"),
                       rounded("mean", 4).alias("mean"))


@query("""
WITH o AS (SELECT 0 AS v UNION ALL SELECT 1)
SELECT CAST(x.v * 2 + y.v AS INTEGER) AS candidate, CAST(x.v AS DOUBLE) AS os_a, CAST(y.v AS DOUBLE) AS os_b,
       round(avg(exp(0.02 * l_quantity + 0.5 + 0.3 * x.v - 0.2 * y.v + 0.5 * (l_linenumber = 0)::INT + 0.1 * (l_linenumber = 1)::INT
                     + 0.4 * (l_linenumber = 2)::INT) - 1), 6) AS mean
FROM lineitem, o x, o y GROUP BY x.v, y.v""")
def response_samples_on_log_model(spark, sf):
    done = search.option_samples(flagged_lines(spark, sf), flag_model(logged=True), "os_", [0, 1], "clicks", logged=True)
    return done.select("candidate", "os_a", "os_b", rounded("mean").alias("mean"))


SETTINGS = "WITH c AS (SELECT i / 10.0::DOUBLE AS g FROM range(1, 31) t(i)), r AS (SELECT i / 10.0::DOUBLE AS r FROM range(1, {top}) t(i)),"


@query(SETTINGS.format(top=21) + """
 s AS (SELECT g, r, regr_r2(l_extendedprice, pow(l_quantity, g) / (pow(l_quantity, g) + r)) AS s FROM lineitem, c, r GROUP BY g, r)
 SELECT g AS gamma, r AS rho, round(s, 6) AS score FROM s ORDER BY s DESC, g, r LIMIT 1""")
def saturating_curve_fit(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = curves.AdbudgRegressor(("l_quantity",), PRICE).fit(rows)
    gamma, rho = model.chosen["l_quantity"]
    fit = model.scores(rows)
    return fit.select(F.lit(gamma).alias("gamma"), F.lit(rho).alias("rho"), rounded("l_extendedprice").alias("score"))


@query(SETTINGS.format(top=21) + """
 x AS (SELECT l_extendedprice AS y, l_quantity + (SELECT min(l_quantity) FROM lineitem) + 1e-8 AS x FROM lineitem),
 s AS (SELECT g, r, regr_r2(y, exp(-pow(ln(x) - r, 2) / (2 * g * g)) / (x * g * sqrt(2 * pi()))) AS s FROM x, c, r GROUP BY g, r)
 SELECT g AS sigma, r AS mu, round(s, 6) AS score FROM s ORDER BY s DESC, g, r LIMIT 1""")
def lognormal_curve_fit(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = curves.LogNormalRegressor(("l_quantity",), PRICE).fit(rows)
    sigma, mu = model.chosen["l_quantity"]
    return model.scores(rows).select(F.lit(sigma).alias("sigma"), F.lit(mu).alias("mu"), rounded("l_extendedprice").alias("score"))


def newton_sql(steps):
    """Newton steps of a Poisson model on every curve, one after the other, over values counted once."""
    sql = [SETTINGS.format(top=21) + """
v AS (SELECT l_quantity AS q, count(*)::DOUBLE AS n, sum(floor(l_extendedprice / 5000)) AS y FROM lineitem GROUP BY 1),
w AS MATERIALIZED (SELECT g, r, pow(q, g) / (pow(q, g) + r) AS x, n, y FROM v, c, r),
a0 AS MATERIALIZED (SELECT g, r, ln(sum(y) / sum(n)) AS b, 0::DOUBLE AS k FROM w GROUP BY g, r)"""]
    for i in range(steps):
        sql.append(f"""
s{i} AS (SELECT g, r, any_value(b) AS b, any_value(k) AS k, sum(y - n * m) AS gb, sum((y - n * m) * x) AS gk, sum(n * m) AS h0, sum(n * m * x) AS h1,
  sum(n * m * x * x) AS h2 FROM (SELECT *, exp(b + k * x) AS m FROM w JOIN a{i} USING (g, r)) GROUP BY g, r),
a{i + 1} AS MATERIALIZED (SELECT g, r, b + (h2 * gb - h1 * gk) / (h0 * h2 - h1 * h1) AS b, k + (h0 * gk - h1 * gb) / (h0 * h2 - h1 * h1) AS k FROM s{i})""")
    return ",".join(sql)


@query(newton_sql(25) + """,
l AS (SELECT g, r, sum(y * (b + k * x) - n * exp(b + k * x)) AS l FROM w JOIN a25 USING (g, r) GROUP BY g, r),
e AS (SELECT avg(f) AS m, avg(CASE WHEN f > 0 THEN f * ln(f) ELSE 0 END) AS e, count(*) AS n FROM (SELECT floor(l_extendedprice / 5000) AS f FROM lineitem))
SELECT g AS gamma, r AS rho, round((l / n - (m * ln(m) - m)) / (e - m - (m * ln(m) - m)), 6) AS score FROM l, e
WHERE isfinite(l) ORDER BY l DESC, g, r LIMIT 1""")
def poisson_curve_fit(spark, sf):
    """The setting whose own Poisson model explains most of the deviance, out of 600."""
    rows = table(spark, sf, "lineitem").select("l_quantity", F.floor(F.col("l_extendedprice") / 5000).alias("steps"))
    model = curves.AdbudgRegressor(("l_quantity",), ("steps",), poisson=True).fit(rows)
    gamma, rho = model.chosen["l_quantity"]
    score = model.search_scores["l_quantity"]
    return spark.range(1).select(F.lit(gamma).alias("gamma"), F.lit(rho).alias("rho"), rounded(F.lit(score)).alias("score"))


@query("WITH c AS (SELECT i / 10.0::DOUBLE AS g FROM range(1, 31) t(i)), r AS (SELECT i / 10.0::DOUBLE AS r FROM range(1, 21) t(i)),"
       " s AS (SELECT g, r, regr_r2(l_extendedprice, pow(l_quantity, g) / (pow(l_quantity, g) + r)) AS s FROM lineitem, c, r GROUP BY g, r)"
       " SELECT round(max(s), 6) AS score FROM s")
def full_curve_search(spark, sf):
    """All 600 settings of the curve in one pass over the rows."""
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    model = curves.AdbudgRegressor(("l_quantity",), PRICE).fit(rows)
    return model.scores(rows).select(rounded("l_extendedprice").alias("score"))


@query("""
SELECT CAST(l_linestatus = 'F' AS INTEGER) AS flag, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS clicks FROM lineitem GROUP BY 1""")
def poisson_on_curve(spark, sf):
    """Poisson model on a curve of one flag: predictions are the means of both sides."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_linestatus") == "F").cast("int").alias("flag"), F.col("l_quantity").alias("clicks"))
    model = curves.AdbudgRegressor(("flag",), ("clicks",), poisson=True)
    done = model.fit_transform(rows)
    return done.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("pred_clicks"), 4).alias("clicks"))


@query("""
WITH t AS (SELECT *, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'valid' END AS split FROM lineitem),
     f AS (SELECT k AS run, ridge, covar_pop(l_quantity, l_extendedprice) / (var_pop(l_quantity) + ridge / count(*)) AS a,
                  avg(l_quantity) AS mx, avg(l_extendedprice) AS my
           FROM t, (SELECT unnest([0, 1000000, 100000000]) AS ridge, unnest([0, 1, 2]) AS k) WHERE split = 'train' GROUP BY 1, 2),
     s AS (SELECT run, split, 1 - sum(pow(l_extendedprice - my - a * (l_quantity - mx), 2)) / (var_pop(l_extendedprice) * count(*)) AS r2
           FROM t, f GROUP BY 1, 2)
SELECT CAST(run AS INTEGER) AS run, round(sum(r2) FILTER (split = 'train'), 6) AS train_score, round(sum(r2) FILTER (split = 'valid'), 6) AS valid_score
FROM s GROUP BY run""")
def model_search_leaderboard(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn(
        "split", F.when(F.col("l_linestatus") == "F", "train").otherwise("valid"))
    candidates = [models.LinearRegressor(("l_quantity",), PRICE, ridge) for ridge in (0.0, 1e6, 1e8)]
    board, _ = search.leaderboard(rows, candidates, "split")
    return board.select("run", rounded("train_score").alias("train_score"), rounded("valid_score").alias("valid_score"))
