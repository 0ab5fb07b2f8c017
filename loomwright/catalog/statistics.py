"""Scaling, components, divergences and prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.catalog.registry import query, rounded, table
from loomwright.operators import decompose, diverge, metrics, scale
from loomwright.operators.models import LinearRegressor

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount"
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"]


def scaled(spark, sf, step, columns=("l_extendedprice", "l_quantity"), digits=6):
    done = step.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, *[rounded(c, digits).alias(c) for c in columns])


@query(f"""
WITH f AS (SELECT quantile_cont(l_extendedprice, 0.5) AS pm, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS pw,
                  quantile_cont(l_quantity, 0.5) AS qm, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS qw FROM lineitem)
SELECT {LINE}, round((l_extendedprice - pm) / pw, 6) + 0.0 AS l_extendedprice, round((l_quantity - qm) / qw, 6) + 0.0 AS l_quantity
FROM lineitem, f""")
def robust_scale(spark, sf):
    return scaled(spark, sf, scale.RobustScale(("l_extendedprice", "l_quantity")))


@query(f"""
WITH f AS (SELECT min(l_extendedprice) AS pm, max(l_extendedprice) - min(l_extendedprice) AS pw,
                  min(l_quantity) AS qm, max(l_quantity) - min(l_quantity) AS qw FROM lineitem)
SELECT {LINE}, round((l_extendedprice - pm) / pw, 6) + 0.0 AS l_extendedprice, round((l_quantity - qm) / qw, 6) + 0.0 AS l_quantity
FROM lineitem, f""")
def minmax_scale(spark, sf):
    return scaled(spark, sf, scale.MinMaxScale(("l_extendedprice", "l_quantity")))


@query(f"""
WITH f AS (SELECT avg(l_extendedprice) AS pm, stddev_samp(l_extendedprice) AS pw, avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qw FROM lineitem)
SELECT {LINE}, round((l_extendedprice - pm) / pw, 6) + 0.0 AS l_extendedprice, round((l_quantity - qm) / qw, 6) + 0.0 AS l_quantity
FROM lineitem, f""")
def standard_scale(spark, sf):
    return scaled(spark, sf, scale.StandardScale(("l_extendedprice", "l_quantity")))


def place_sql(column: str, marks: int = 21) -> str:
    """Interpolated place among equally spaced quantiles; ties take the middle."""
    steps = ", ".join(f"{k}::DOUBLE / {marks - 1}" for k in range(marks))
    return f"""
q AS (SELECT unnest(quantile_cont({column}, [{steps}])) AS m, unnest(range(0, {marks})) AS i FROM lineitem),
d AS (SELECT DISTINCT {column} AS x FROM lineitem),
up AS (SELECT x, max(i) AS i FROM d JOIN q ON m <= x GROUP BY x),
down AS (SELECT x, min(i) AS i FROM d JOIN q ON m >= x GROUP BY x),
edge AS (SELECT min(m) AS lo, max(m) AS hi FROM q),
place AS (SELECT d.x, CASE WHEN d.x <= lo THEN 0::DOUBLE WHEN d.x >= hi THEN 1::DOUBLE ELSE (
    (up.i + coalesce((d.x - a.m) / nullif(b.m - a.m, 0), 0)) + (down.i - coalesce((e.m - d.x) / nullif(e.m - c.m, 0), 0))
  ) / 2 / {marks - 1} END AS p
  FROM d JOIN up USING (x) JOIN down USING (x) CROSS JOIN edge
  JOIN q a ON a.i = up.i LEFT JOIN q b ON b.i = up.i + 1 JOIN q e ON e.i = down.i LEFT JOIN q c ON c.i = down.i - 1)"""


@query(f"WITH {place_sql('l_extendedprice')} SELECT {LINE}, round(p, 6) AS l_extendedprice FROM lineitem JOIN place ON x = l_extendedprice")
def quantile_uniform(spark, sf):
    return scaled(spark, sf, scale.QuantileUniform(("l_extendedprice",), 21), ("l_extendedprice",))


@query(f"WITH {place_sql('l_quantity', 101)} SELECT {LINE}, round(p, 6) AS l_quantity FROM lineitem JOIN place ON x = l_quantity")
def quantile_uniform_with_ties(spark, sf):
    return scaled(spark, sf, scale.QuantileUniform(("l_quantity",), 101), ("l_quantity",))


@query(f"""
WITH {place_sql('l_extendedprice')},
z AS (SELECT x, p, p - 0.5 AS c, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(greatest(least(p, 1 - p), 1e-7))) AS t FROM place),
n AS (SELECT x, CASE WHEN p <= 1e-7 THEN -5.199337582605575::DOUBLE WHEN p >= 1 - 1e-7 THEN 5.199337582605575::DOUBLE
  WHEN p < 0.02425 THEN (((((-7.784894002430293e-03 * t - 3.223964580411365e-01) * t - 2.400758277161838e+00) * t - 2.549732539343734e+00) * t
       + 4.374664141464968e+00) * t + 2.938163982698783e+00) / ((((7.784695709041462e-03 * t + 3.224671290700398e-01) * t + 2.445134137142996e+00) * t
       + 3.754408661907416e+00) * t + 1)
  WHEN p > 1 - 0.02425 THEN -(((((-7.784894002430293e-03 * t - 3.223964580411365e-01) * t - 2.400758277161838e+00) * t - 2.549732539343734e+00) * t
       + 4.374664141464968e+00) * t + 2.938163982698783e+00) / ((((7.784695709041462e-03 * t + 3.224671290700398e-01) * t + 2.445134137142996e+00) * t
       + 3.754408661907416e+00) * t + 1)
  ELSE (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r - 2.759285104469687e+02) * r + 1.383577518672690e+02) * r
       - 3.066479806614716e+01) * r + 2.506628277459239e+00) * c / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r
       - 1.556989798598866e+02) * r + 6.680131188771972e+01) * r - 1.328068155288572e+01) * r + 1) END AS v FROM z)
SELECT {LINE}, round(v, 6) + 0.0 AS l_extendedprice FROM lineitem JOIN n ON x = l_extendedprice""")
def quantile_normal(spark, sf):
    return scaled(spark, sf, scale.QuantileNormal(("l_extendedprice",), 21), ("l_extendedprice",))


@query(f"""
WITH f AS (SELECT min(l_quantity) AS qm, max(l_quantity) - min(l_quantity) AS qw, quantile_cont(l_extendedprice, 0.5) AS pm,
                  quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS pw FROM lineitem)
SELECT {LINE}, round((l_extendedprice - pm) / pw, 6) + 0.0 AS l_extendedprice, round((l_quantity - qm) / qw, 6) + 0.0 AS l_quantity
FROM lineitem, f""")
def scaler_by_name(spark, sf):
    rows = table(spark, sf, "lineitem")
    done = scale.scaler("MinMaxScaler", ("l_quantity",)).fit_transform(rows)
    done = scale.scaler("no such scaler", ("l_extendedprice",)).fit_transform(done)
    return done.select(*LINE_KEYS, *[rounded(c).alias(c) for c in ("l_extendedprice", "l_quantity")])


@query(f"""
WITH f AS (SELECT min(l_quantity) AS m, max(l_quantity) - min(l_quantity) AS w, min(l_tax) AS tm, max(l_tax) - min(l_tax) AS tw FROM lineitem)
SELECT {LINE}, round((l_quantity - m) / w, 6) AS l_quantity_transformed, round((l_tax - tm) / tw, 6) AS l_tax_transformed FROM lineitem, f""")
def estimator_per_column(spark, sf):
    from pyspark.ml.feature import MinMaxScaler

    step = scale.PerColumn(("l_quantity", "l_tax"), lambda i, o: MinMaxScaler(inputCol=i, outputCol=o))
    done = step.fit_transform(table(spark, sf, "lineitem"))
    return done.select(*LINE_KEYS, *[rounded(c).alias(c) for c in ("l_quantity_transformed", "l_tax_transformed")])


def component_rows(spark, sf, step, name):
    """Scores as a long table."""
    done = step.fit_transform(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return done.select("vec_id", F.posexplode(name).alias("component", "score"))


@query()
def principal_components(spark, sf):
    return component_rows(spark, sf, decompose.Pca(("embedding",), 8, as_array=True), "embedding_pc")


@query(f"""
WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice / 2000) AS mb, var_pop(l_quantity) AS va, var_pop(l_extendedprice / 2000) AS vb,
                  covar_pop(l_quantity, l_extendedprice / 2000) AS c FROM lineitem),
     e AS (SELECT *, (va + vb) / 2 + sqrt((va - vb) * (va - vb) / 4 + c * c) AS l1, (va + vb) / 2 - sqrt((va - vb) * (va - vb) / 4 + c * c) AS l2 FROM m),
     v AS (SELECT *, c AS x1, l1 - va AS y1, c AS x2, l2 - va AS y2 FROM e),
     s AS (SELECT *, (CASE WHEN abs(x1) >= abs(y1) THEN sign(x1) ELSE sign(y1) END) / sqrt(x1 * x1 + y1 * y1) AS n1,
                  (CASE WHEN abs(x2) >= abs(y2) THEN sign(x2) ELSE sign(y2) END) / sqrt(x2 * x2 + y2 * y2) AS n2 FROM v)
SELECT {LINE}, round(((l_quantity - ma) * x1 + (l_extendedprice / 2000 - mb) * y1) * n1, 5) + 0.0 AS x_pc_0,
       round(((l_quantity - ma) * x2 + (l_extendedprice / 2000 - mb) * y2) * n2, 5) + 0.0 AS x_pc_1
FROM lineitem, s""")
def principal_components_of_two(spark, sf):
    """Two columns, where the components have a closed form."""
    rows = table(spark, sf, "lineitem").withColumns({"x_0": F.col("l_quantity"), "x_1": F.col("l_extendedprice") / 2000})
    done = decompose.Pca(("x_0", "x_1")).fit_transform(rows)
    return done.select(*LINE_KEYS, *[rounded(c, 5).alias(c) for c in ("x_pc_0", "x_pc_1")])


def squared_length(done, name):
    return done.select("vec_id", rounded(F.aggregate(name, F.lit(0.0), lambda a, x: a + x * x), 5).alias("length"))


@query("""
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
     m AS (SELECT i, avg(v) AS m FROM u GROUP BY i)
SELECT vec_id, round(sum((v - m) * (v - m)), 5) AS length FROM u JOIN m USING (i) GROUP BY vec_id""")
def principal_components_keep_lengths(spark, sf):
    """All components together are a rotation: distances from the mean stay as they are."""
    done = decompose.Pca(("embedding",), as_array=True).fit_transform(table(spark, sf, "embeddings"))
    return squared_length(done, "embedding_pc")


@query("""
WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
     m AS (SELECT i, avg(v) AS m, stddev_samp(v) AS s FROM u GROUP BY i)
SELECT vec_id, round(sum(pow((v - m) / s, 2)), 5) AS length FROM u JOIN m USING (i) GROUP BY vec_id""")
def low_rank_keeps_lengths(spark, sf):
    """With every component kept, the length of the standardised vector stays."""
    step = decompose.LowRank(("embedding",), n_min=64, n_max=65, as_array=True)
    return squared_length(step.fit_transform(table(spark, sf, "embeddings")), "embedding_pc")


@query("""
WITH m AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice / 2000) AS mb, var_pop(l_quantity) AS va, var_pop(l_extendedprice / 2000) AS vb,
                  covar_pop(l_quantity, l_extendedprice / 2000) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, round((vb * pow(l_quantity - ma, 2) + va * pow(l_extendedprice / 2000 - mb, 2)
   - 2 * c * (l_quantity - ma) * (l_extendedprice / 2000 - mb)) / (va * vb - c * c), 5) + 0.0 AS length FROM lineitem, m""")
def independent_components_are_white(spark, sf):
    """Two independent components: the squared length is the distance in units of the covariance."""
    rows = table(spark, sf, "lineitem").withColumns({"x_0": F.col("l_quantity"), "x_1": F.col("l_extendedprice") / 2000})
    done = decompose.Ica(("x_0", "x_1")).fit_transform(rows)
    length = F.pow("x_ic_0", F.lit(2.0)) + F.pow("x_ic_1", F.lit(2.0))
    return done.select(*LINE_KEYS, rounded(length, 5).alias("length"))


@query()
def low_rank_components(spark, sf):
    return component_rows(spark, sf, decompose.LowRank(("embedding",), n_min=6, n_max=20, as_array=True), "embedding_pc")


@query()
def factor_scores(spark, sf):
    return component_rows(spark, sf, decompose.FactorAnalysis(("embedding",), 4, as_array=True), "embedding_ca")


@query()
def independent_components(spark, sf):
    return component_rows(spark, sf, decompose.Ica(("embedding",), 4, as_array=True), "embedding_ic")


@query()
def kernel_components_rbf(spark, sf):
    return component_rows(spark, sf, decompose.kernel_pca("rbf", ["embedding"], n_components=4, as_array=True), "embedding_rbfpc")


@query()
def kernel_components_poly(spark, sf):
    """All 2,145 monomials of 64 numbers up to degree 2."""
    return component_rows(spark, sf, decompose.kernel_pca("poly", ["embedding"], degree=2, n_components=4, as_array=True), "embedding_polypc")


@query(f"""
WITH x AS (SELECT *, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem),
     phi AS (SELECT *, [sqrt(3 * g) * a, sqrt(3 * g) * b, sqrt(3) * g * a * a, sqrt(6) * g * a * b, sqrt(3) * g * b * b, pow(g, 1.5) * pow(a, 3),
                        sqrt(3) * pow(g, 1.5) * a * a * b, sqrt(3) * pow(g, 1.5) * a * b * b, pow(g, 1.5) * pow(b, 3)] AS f FROM x, (SELECT 7.0::DOUBLE / 16 AS g)),
     m AS (SELECT [avg(f[1]), avg(f[2]), avg(f[3]), avg(f[4]), avg(f[5]), avg(f[6]), avg(f[7]), avg(f[8]), avg(f[9])] AS m FROM phi)
SELECT {LINE}, round(list_sum(list_transform(range(1, 10), lambda i: pow(f[i] - m[i], 2))), 5) AS length FROM phi, m""")
def kernel_components_poly_keep_lengths(spark, sf):
    """All components of the cubic kernel: the distance from the mean of all monomials stays."""
    rows = table(spark, sf, "lineitem").withColumns({"x_0": F.col("l_quantity") / 50, "x_1": F.col("l_discount") * 10})
    done = decompose.kernel_pca("poly", ["x_0", "x_1"], n_components=10, as_array=True).fit_transform(rows)
    return done.select(*LINE_KEYS, rounded(F.aggregate("x_polypc", F.lit(0.0), lambda a, x: a + x * x), 5).alias("length"))


@query("SELECT doc_id, round(n_chars::DOUBLE, 2) AS v_0, round(n_chars * 2.5::DOUBLE, 2) AS v_1, round(n_chars * 0.2::DOUBLE, 2) AS v_2 FROM documents")
def non_negative_parts_of_outer_product(spark, sf):
    """Rows that are multiples of one profile are given back by one part."""
    rows = table(spark, sf, "documents").select("doc_id", *[(F.col("n_chars") * w).alias(f"v_{k}") for k, w in enumerate((1.0, 2.5, 0.2))])
    step = decompose.Nmf(("v_0", "v_1", "v_2"), 1).fit(rows)
    return step(rows).select("doc_id", *[rounded(F.col("v_nfm_0") * step.loadings[0][k], 2).alias(f"v_{k}") for k in range(3)])


@query()
def non_negative_parts(spark, sf):
    """Parts of the squared embeddings, none of whose cells is negative."""
    squares = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v * v).cast("double")).alias("embedding"))
    done = decompose.Nmf(("embedding",), 4, as_array=True).fit_transform(squares)
    return done.select("vec_id", F.posexplode("embedding_nfm").alias("component", "score"))


def price_samples(spark, sf):
    """Line prices and order totals on one scale."""
    lines = diverge.sample(table(spark, sf, "lineitem"), "l_extendedprice")
    orders = table(spark, sf, "orders").withColumn("part", F.col("o_totalprice") / 4)
    return lines, diverge.sample(orders, "part")


HEIGHTS = """
WITH a AS (SELECT l_extendedprice AS v FROM lineitem), b AS (SELECT o_totalprice / 4 AS v FROM orders),
     e AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT v FROM a UNION ALL SELECT v FROM b)),
     p AS (SELECT least(floor((v - lo) / (hi - lo) * {n}), {n} - 1) AS bin, count(*) / (SELECT count(*) FROM a) AS p FROM a, e GROUP BY 1),
     q AS (SELECT least(floor((v - lo) / (hi - lo) * {n}), {n} - 1) AS bin, count(*) / (SELECT count(*) FROM b) AS q FROM b, e GROUP BY 1)
"""


@query(HEIGHTS.format(n=24) + """
SELECT CAST(bin AS INTEGER) AS bin, round(p, 6) AS p, round(q, 6) AS q FROM p JOIN q USING (bin)""")
def shared_histogram(spark, sf):
    done = diverge.shared_histogram(*price_samples(spark, sf), bins=24)
    return done.select("bin", rounded("p").alias("p"), rounded("q").alias("q"))


@query(HEIGHTS.format(n=24) + """
SELECT round(sum(p * ln(p / q)), 6) AS kl, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 6) AS js,
       round(sum(abs(p - q)), 6) AS own
FROM p JOIN q USING (bin)""")
def histogram_divergences(spark, sf):
    functions = {"kl": diverge.kl, "js": diverge.js, "own": lambda p, q: F.sum(F.abs(p - q))}
    done = diverge.divergences(*price_samples(spark, sf), functions, bins=24)
    return done.select(*[rounded(c).alias(c) for c in functions])


AREA = """
s AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT v, 1 AS a, 0 AS b FROM left_side UNION ALL SELECT v, 0, 1 FROM right_side) GROUP BY v),
r AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS fb, lead(v) OVER (ORDER BY v) AS nxt FROM s)
SELECT round(sum(abs(fa - fb) * (nxt - v)), {digits}) AS distance FROM r"""


@query(HEIGHTS.format(n=24) + ", left_side AS (SELECT p AS v FROM p JOIN q USING (bin)), right_side AS (SELECT q AS v FROM p JOIN q USING (bin)), "
       + AREA.format(digits=6))
def height_distance(spark, sf):
    done = diverge.wasserstein_of_heights(*price_samples(spark, sf), bins=24)
    return done.select(rounded("distance").alias("distance"))


@query("WITH left_side AS (SELECT l_extendedprice AS v FROM lineitem), right_side AS (SELECT o_totalprice / 4 AS v FROM orders), "
       + AREA.format(digits=3))
def wasserstein_distance(spark, sf):
    return diverge.wasserstein(*price_samples(spark, sf)).select(rounded("distance", 3).alias("distance"))


def scored_lines(spark, sf):
    return table(spark, sf, "lineitem").withColumns({
        "pred": F.col("l_quantity") * 2000 + 3000, "pred_discount": F.col("l_tax") * 0.5 + 0.03,
        "split": F.when(F.col("l_linestatus") == "F", "train").otherwise("valid"),
    })


SCORED = """WITH t AS (SELECT *, l_quantity * 2000 + 3000 AS pred, l_tax * 0.5 + 0.03 AS pred_discount,
  CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'valid' END AS split FROM lineitem)
"""


@query(SCORED + """
SELECT split, round(1 - sum(pow(l_extendedprice - pred, 2)) / (var_pop(l_extendedprice) * count(*)), 6) + 0.0 AS r2_l_extendedprice,
       round(sqrt(avg(pow(ln(1 + pred) - ln(1 + l_extendedprice), 2))), 6) AS rmsle_l_extendedprice,
       round(avg(pow(l_extendedprice - pred, 2)), 2) AS mse_l_extendedprice,
       round(1 - sum(pow(l_discount - pred_discount, 2)) / (var_pop(l_discount) * count(*)), 6) + 0.0 AS r2_l_discount,
       round(sqrt(avg(pow(ln(1 + pred_discount) - ln(1 + l_discount), 2))), 6) AS rmsle_l_discount,
       round(avg(pow(l_discount - pred_discount, 2)), 6) AS mse_l_discount
FROM t GROUP BY split""")
def prediction_scores(spark, sf):
    pairs = {"l_extendedprice": "pred", "l_discount": "pred_discount"}
    done = metrics.scores(scored_lines(spark, sf), pairs, {"r2": metrics.r2, "rmsle": metrics.rmsle, "mse": metrics.mse}, ["split"])
    digits = {"mse_l_extendedprice": 2}
    return done.select("split", *[rounded(c, digits.get(c, 6)).alias(c) for c in done.columns if c != "split"])


@query(SCORED + """
, z AS (SELECT split, l_discount AS y, pred_discount AS p FROM t WHERE l_discount <> 0),
  e AS (SELECT split, min(least(y, p)) AS lo, max(greatest(y, p)) AS hi, count(*) AS n FROM z GROUP BY 1),
  hp AS (SELECT split, least(floor((p - lo) / (hi - lo) * 96), 95) AS bin, count(*) / any_value(n) AS p FROM z JOIN e USING (split) GROUP BY 1, 2),
  hq AS (SELECT split, least(floor((y - lo) / (hi - lo) * 96), 95) AS bin, count(*) / any_value(n) AS q FROM z JOIN e USING (split) GROUP BY 1, 2),
  js AS (SELECT split, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 AS js FROM hp JOIN hq USING (split, bin) GROUP BY 1),
  m AS (SELECT split, 1 - sum(pow(l_discount - pred_discount, 2)) / (var_pop(l_discount) * count(*)) AS score,
        avg(exp(pred_discount) - l_discount * pred_discount) AS pnll, avg(abs(l_discount - pred_discount)) AS mae,
        avg(abs(l_discount - pred_discount)) FILTER (l_discount <> 0) AS nzmae, stddev_samp(l_discount) AS sd FROM t GROUP BY 1)
SELECT split, round(score, 6) + 0.0 AS score, round(pnll, 6) AS poisson_loss, round(mae, 6) AS mae, round(nzmae, 6) AS non_zero_mae,
       round(1 - mae / sd, 6) + 0.0 AS mad_acc, round(js, 6) AS non_zero_js_div
FROM m LEFT JOIN js USING (split)""")
def metric_rows(spark, sf):
    done = metrics.metric_rows(scored_lines(spark, sf), "l_discount", "pred_discount", "split")
    return done.select("split", *[rounded(c).alias(c) for c in done.columns if c != "split"])


@query("""
WITH t AS (SELECT coalesce(nullif(l_partkey, 7), -1) AS split, l_discount AS y, l_tax * 0.5 + 0.03 AS p FROM lineitem),
  z AS (SELECT * FROM t WHERE y <> 0),
  e AS (SELECT split, min(least(y, p)) AS lo, max(greatest(y, p)) AS hi, count(*) AS n FROM z GROUP BY 1),
  hp AS (SELECT split, least(floor((p - lo) / (hi - lo) * 8), 7) AS bin, count(*) / any_value(n) AS p FROM z JOIN e USING (split) GROUP BY 1, 2),
  hq AS (SELECT split, least(floor((y - lo) / (hi - lo) * 8), 7) AS bin, count(*) / any_value(n) AS q FROM z JOIN e USING (split) GROUP BY 1, 2),
  js AS (SELECT split, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 AS js FROM hp JOIN hq USING (split, bin) GROUP BY 1),
  m AS (SELECT split, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS score, avg(abs(y - p)) AS mae FROM t GROUP BY 1)
SELECT nullif(split, -1) AS split, round(score, 6) + 0.0 AS score, round(mae, 6) AS mae, round(js, 6) AS non_zero_js_div FROM m LEFT JOIN js USING (split)""")
def metric_rows_of_many_splits(spark, sf):
    """Thousands of splits, one of them without a name."""
    rows = table(spark, sf, "lineitem").select(
        F.nullif(F.col("l_partkey"), F.lit(7)).alias("split"), "l_discount", (F.col("l_tax") * 0.5 + 0.03).alias("pred"))
    done = metrics.metric_rows(rows, "l_discount", "pred", "split", bins=8)
    return done.select("split", *[rounded(c).alias(c) for c in ("score", "mae", "non_zero_js_div")])


SPREADS = SCORED + """
, s AS (SELECT var_pop(l_extendedprice) / pow(max(l_extendedprice) - min(l_extendedprice), 2) AS vy, var_pop(pred) / pow(max(pred) - min(pred), 2) AS vp,
        var_pop(l_discount) / pow(max(l_discount) - min(l_discount), 2) AS wy, var_pop(pred_discount) / pow(max(pred_discount) - min(pred_discount), 2) AS wp,
        var_pop(l_quantity) / pow(max(l_quantity) - min(l_quantity), 2) AS vx, var_pop(l_tax) / pow(max(l_tax) - min(l_tax), 2) AS wx FROM t)
"""
PAIRS = {"l_extendedprice": "pred", "l_discount": "pred_discount"}


@query(SPREADS + """
SELECT 'l_extendedprice' AS target, round(abs(vy - vp) / vy, 6) AS deviation FROM s
UNION ALL SELECT 'l_discount', round(abs(wy - wp) / wy, 6) FROM s""")
def target_spread(spark, sf):
    done, _ = metrics.variance_test(scored_lines(spark, sf), ["l_quantity", "l_tax"], PAIRS)
    return done.withColumn("deviation", rounded("deviation"))


@query(SPREADS + """
SELECT 'l_quantity' AS feature, 'l_extendedprice' AS target, round(abs(vx - vp) / vx, 6) AS deviation FROM s
UNION ALL SELECT 'l_quantity', 'l_discount', round(abs(vx - wp) / vx, 6) FROM s
UNION ALL SELECT 'l_tax', 'l_extendedprice', round(abs(wx - vp) / wx, 6) FROM s
UNION ALL SELECT 'l_tax', 'l_discount', round(abs(wx - wp) / wx, 6) FROM s""")
def feature_spread(spark, sf):
    _, done = metrics.variance_test(scored_lines(spark, sf), ["l_quantity", "l_tax"], PAIRS)
    return done.withColumn("deviation", rounded("deviation"))


@query(f"""
WITH f AS (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v, sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * var_pop(l_extendedprice)) AS s FROM lineitem)
SELECT {LINE}, round(s * sqrt(1 + pow(m - l_quantity, 2) / v), 3) AS confidence FROM lineitem, f""")
def prediction_confidence(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = LinearRegressor(("l_quantity",), ("l_extendedprice",)).fit(rows)
    return rows.select(*LINE_KEYS, rounded(model.confidence(rows, "l_extendedprice"), 3).alias("confidence"))


@query("""
WITH r AS (SELECT o_totalprice * 0.2 AS p, least(o_totalprice / 400, 1300) AS x FROM orders),
     d AS (SELECT abs(p - (81.589082::DOUBLE * x + 0.189342::DOUBLE * x * x - 0.000104::DOUBLE * x * x * x)) AS d FROM r)
SELECT round(avg(d), 3) AS mad, round(avg(d * d), 0) AS msd, CAST(count(*) FILTER (d > 50000) AS BIGINT) AS fails,
       round(count(*) FILTER (d > 50000) / count(*), 6) AS fail_rate FROM d""")
def curve_conformance(spark, sf):
    rows = table(spark, sf, "orders").select(
        (F.col("o_totalprice") * 0.2).alias("pred"), (F.col("o_totalprice") / 400).alias("booked_revenue_usd"))
    done = metrics.conformance(rows, "booked_revenue_usd", "pred")
    return done.select(rounded("mad", 3).alias("mad"), rounded("msd", 0).alias("msd"), "fails", rounded("fail_rate").alias("fail_rate"))
