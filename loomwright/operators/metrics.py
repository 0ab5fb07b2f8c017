"""Scores of predictions, prediction spread, confidence and conformance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import mathops
from loomwright.plans.columns import filled, number, q
from loomwright.plans.joins import salted_join
from loomwright.session import stored

Score = Callable[[Column, Column], Column]


def r2(y: Column, p: Column) -> Column:
    """Share of the variance of ``y`` that ``p`` explains; 1 for a constant met exactly, else 0."""
    left = F.sum(F.pow(y - p, F.lit(2.0)))
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - left / total).when(left == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def mse(y: Column, p: Column) -> Column:
    return F.avg(F.pow(y - p, F.lit(2.0)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmsle(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(F.log1p(p) - F.log1p(y), F.lit(2.0))))


def poisson_loss(y: Column, p: Column) -> Column:
    return F.avg(F.exp(p) - y * p)


def scores(
    df: DataFrame, pairs: Mapping[str, str], functions: Mapping[str, Score], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per group and one column ``<score>_<target>`` per pair target -> prediction."""
    exprs = [
        f(filled(df, y), filled(df, p)).alias(f"{name}_{y}") for y, p in pairs.items() for name, f in functions.items()
    ]
    return df.groupBy(*keys).agg(*exprs)


def metric_rows(df: DataFrame, target: str, prediction: str, split: str, bins: int = 96) -> DataFrame:
    """Per split: R2, Poisson loss, MAE, MAE and divergence where the target is not 0, and 1 - MAE/spread.

    The histogram range is that of the split's non-zero rows, targets and predictions together.
    """
    y, p = F.col("_y"), F.col("_p")
    rows = df.select(q(split).alias(split), filled(df, target).alias("_y"), filled(df, prediction).alias("_p"))
    table = stored(rows.groupBy(split).agg(
        r2(y, p).alias("score"), poisson_loss(y, p).alias("poisson_loss"), mae(y, p).alias("mae"),
        F.avg(F.when(y != 0, F.abs(y - p))).alias("non_zero_mae"),
        (1 - mae(y, p) / F.stddev_samp(y)).alias("mad_acc"),
        F.min(F.when(y != 0, F.least(y, p))).alias("_lo"), F.max(F.when(y != 0, F.greatest(y, p))).alias("_hi"), F.count(F.lit(1)).alias("_n"),
    ), "splits")
    # a split that is NULL is one like any other: its name is kept in a struct, which joins on equal content
    one = F.when(F.col("_lo") == F.col("_hi"), 1.0).otherwise(0.0)
    ends = table.select(F.struct(q(split)).alias("_split"), (F.col("_lo") - one).alias("_lo"), (F.col("_hi") + one).alias("_hi"), "_n")
    ranged = salted_join(
        rows.where(y != 0).select(F.struct(q(split)).alias("_split"), "_y", "_p"), ends.drop("_n"), ["_split"], "inner",
        counts=ends.select("_split", "_n"))

    def place(v: Column) -> Column:
        width = F.col("_hi") - F.col("_lo")
        return F.least(F.floor((v - F.col("_lo")) / width * F.lit(bins)), F.lit(bins - 1)).cast("int")

    sides = (
        ranged.select(F.col("_split")[split].alias(split), F.explode(F.array(
            F.struct(place(y).alias("bin"), F.lit(1).alias("y"), F.lit(0).alias("p")),
            F.struct(place(p).alias("bin"), F.lit(0).alias("y"), F.lit(1).alias("p")),
        )).alias("_side"))
        .select(q(split), F.col("_side.bin").alias("_bin"), F.col("_side.y").alias("_y"), F.col("_side.p").alias("_p"))
        .groupBy(q(split), "_bin").agg(F.sum("_y").alias("_y"), F.sum("_p").alias("_p"))
    )
    whole = Window.partitionBy(q(split))
    shares = sides.select(
        q(split), (F.col("_p") / F.sum("_p").over(whole)).alias("_p"), (F.col("_y") / F.sum("_y").over(whole)).alias("_q")
    ).where((F.col("_p") > 0) & (F.col("_q") > 0))
    from loomwright.operators.diverge import js

    divergence = shares.groupBy(q(split)).agg(js(F.col("_p"), F.col("_q")).alias("non_zero_js_div"))
    named = divergence.select(F.struct(q(split)).alias("_split"), "non_zero_js_div")
    whole_table = table.drop("_lo", "_hi", "_n").withColumn("_split", F.struct(q(split)))
    return whole_table.join(named, "_split", "left").drop("_split")


def scaled_variance(value: Column) -> Column:
    """Population variance after scaling to [0, 1]."""
    return F.try_divide(F.var_pop(value), F.pow(F.max(value) - F.min(value), F.lit(2.0)))


def variance_test(
    df: DataFrame, features: Sequence[str], pairs: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """How far the spread of predictions is from the spread of targets and of features.

    Returns (target, deviation) and (feature, target, deviation), both from one pass over the rows.
    """
    names = [*features, *pairs.keys(), *pairs.values()]
    row = df.agg(*[scaled_variance(filled(df, c)).alias(f"v{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"v{i}") for i, c in enumerate(names)}
    by_target = F.array(*[
        F.struct(F.lit(y).alias("target"), F.try_divide(F.abs(at[y] - at[p]), at[y]).alias("deviation"))
        for y, p in pairs.items()
    ])
    by_feature = F.array(*[
        F.struct(F.lit(x).alias("feature"), F.lit(y).alias("target"),
                 F.try_divide(F.abs(at[x] - at[p]), at[x]).alias("deviation"))
        for x in features for y, p in pairs.items()
    ])
    return row.select(F.inline(by_target)), row.select(F.inline(by_feature))


def confidence(
    df: DataFrame, features: Sequence[str], mean: Mapping[str, float | Column], variance: Mapping[str, float | Column],
    spread: float | Column,
) -> Column:
    """Mean over the features of ``spread * sqrt(1 + (mean - x)^2 / variance)``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    total = F.lit(0.0)
    for c in features:
        away = F.pow(as_column(mean[c]) - number(df, c), F.lit(2.0))
        total = total + as_column(spread) * F.sqrt(1 + F.try_divide(away, as_column(variance[c])))
    return total / F.lit(float(len(features)))


# The reference curve that predictions are checked against.
CURVE = (0.0, 81.589082, 0.189342, -0.000104)
CURVE_CUT = 1_300.0
CURVE_THRESHOLD = 50_000.0


def conformance(
    df: DataFrame, x: str, prediction: str, curve: Sequence[float] = CURVE, cut: float | None = CURVE_CUT,
    threshold: float = CURVE_THRESHOLD,
) -> DataFrame:
    """Mean absolute and squared distance from the curve, and how often it exceeds the threshold."""
    away = number(df, prediction) - mathops.polynomial(number(df, x), curve, cut)
    miss = F.coalesce(F.abs(away) > F.lit(threshold), F.lit(False))
    total = F.count(F.lit(1))
    return df.agg(
        (F.sum(F.abs(away)) / total).alias("mad"), (F.sum(away * away) / total).alias("msd"),
        F.count_if(miss).alias("fails"), (F.count_if(miss) / total).alias("fail_rate"),
    )
