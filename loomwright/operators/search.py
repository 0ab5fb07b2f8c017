"""What-if analysis: recommending input values, responses over option grids, model search.

The question is always the mean (or spread) of predictions when some columns of every row are replaced
by a candidate. Rows are never paired with candidates in a table. For linear models the rows enter through one
number per target, so one aggregate pass answers all candidates. Trees and other models with a matrix form
(``evaluate``) walk through the candidates inside the tasks, which hand back sums; so does a chain of row-wise steps.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.operators import metrics
from loomwright.operators.aggregate import search_range
from loomwright.operators.evaluate import evaluator, inputs
from loomwright.operators.models import LinearRegressor, Regressor, prediction_name
from loomwright.plans.columns import containing, filled, lit_array, q, with_all
from loomwright.plans.moments import partial_sums
from loomwright.plans.operator import Chain
from loomwright.session import stored

# How many rounds and draws a recommendation uses, and where values are looked for.
ROUNDS, DRAWS = 80, 25
DEFAULT_SPACE = (-200.0, 200.0)
# Width of the likelihood around the best round, and the sparsity objective.
LIKELIHOOD_WIDTH = 0.05
PLAIN_SHARE, SPREAD_SHARE = 0.7, 0.3
EVALUATIONS = 15
# candidates per job when steps behind the replaced columns need the whole table
PER_JOB = 20
# predictions that a task makes at a time
EVALUATED = 1 << 16


@dataclass(frozen=True)
class Candidates:
    """A small driver-made table of candidate values; one dict per candidate."""

    columns: tuple[str, ...]
    rows: tuple[tuple[float, ...], ...]

    @property
    def count(self) -> int:
        return len(self.rows)

    def block(self, low: int, high: int) -> np.ndarray:
        """The candidates from ``low`` to before ``high`` as a matrix."""
        return np.array(self.rows[low:high], float).reshape(-1, len(self.columns))

    def settings(self) -> list[dict[str, float]]:
        return [dict(zip(self.columns, r)) for r in self.block(0, self.count).tolist()]

    def table(self, spark: SparkSession, id_name: str = "candidate") -> DataFrame:
        fields = ", ".join(f"`{c}` double" for c in self.columns)
        return spark.createDataFrame(
            [(i, *map(float, r)) for i, r in enumerate(self.rows)], f"{id_name} int, {fields}"
        )


@dataclass(frozen=True)
class OptionGrid:
    """All combinations of some options, never listed: a combination follows from its number.

    The last column changes fastest. ``normalized`` divides every combination by its sum; one that sums to 0 has no value.
    """

    columns: tuple[str, ...]
    options: tuple[float, ...]
    normalized: bool = False

    @property
    def count(self) -> int:
        return len(self.options) ** len(self.columns)

    @property
    def rows(self) -> list[tuple[float, ...]]:
        return [*map(tuple, self.block(0, self.count).tolist())]

    def steps(self) -> list[int]:
        return [len(self.options) ** k for k in reversed(range(len(self.columns)))]

    def block(self, low: int, high: int) -> np.ndarray:
        number = np.arange(low, min(high, self.count))
        values = np.array(self.options)[number[:, None] // np.array(self.steps(), np.int64)[None] % len(self.options)]
        if self.normalized:
            total = values.sum(1, keepdims=True)
            values = np.divide(values, total, out=np.full_like(values, math.nan), where=total != 0)
        return values

    def settings(self) -> list[dict[str, float]]:
        return [dict(zip(self.columns, r)) for r in self.rows]

    def table(self, spark: SparkSession, id_name: str = "candidate") -> DataFrame:
        options = F.array(*[F.lit(o) for o in self.options])
        values = [F.get(options, (F.floor(F.col("id") / step) % len(self.options)).cast("int")) for step in self.steps()]
        if self.normalized:
            total = reduce(operator.add, values)
            values = [F.when(total != 0, v / total).otherwise(F.lit(math.nan)) for v in values]
        return spark.range(self.count).select(F.col("id").cast("int").alias(id_name), *[v.alias(c) for c, v in zip(self.columns, values)])


def random_candidates(
    spaces: Mapping[str, tuple[float, float]], count: int = ROUNDS * DRAWS, seed: int = 42
) -> Candidates:
    draw = np.random.default_rng(seed)
    columns = tuple(spaces)
    values = np.column_stack([draw.uniform(*spaces[c], count) for c in columns])
    return Candidates(columns, tuple(map(tuple, values.tolist())))


def even_candidates(spaces: Mapping[str, tuple[float, float]], count: int = EVALUATIONS) -> Candidates:
    """Evenly filling points: additive steps by the powers of the generalised golden ratio."""
    columns = tuple(spaces)
    ratio = 2.0
    for _ in range(60):
        ratio = (1 + ratio) ** (1 / (len(columns) + 1))
    rows = []
    for i in range(1, count + 1):
        places = [(0.5 + i / ratio ** (j + 1)) % 1.0 for j in range(len(columns))]
        rows.append(tuple(spaces[c][0] + p * (spaces[c][1] - spaces[c][0]) for c, p in zip(columns, places)))
    return Candidates(columns, tuple(rows))


def option_candidates(columns: Sequence[str], options: Sequence[float], normalized: bool = False) -> OptionGrid:
    """All combinations of the options; optionally every combination divided by its sum."""
    return OptionGrid(tuple(columns), tuple(float(o) for o in options), normalized)


def mean_responses(
    df: DataFrame, model: Regressor, target: str, candidates: Candidates | OptionGrid, logged: bool = False,
    prepare: Chain | None = None,
) -> DataFrame:
    """Per candidate: mean and mean square of the predictions over all rows.

    ``logged`` means the model predicts ``log(1 + y)`` and responses are wanted for ``y``. ``prepare`` is
    a fitted chain that runs on the rows first; its steps up to the first one that reads a replaced column
    run once, the others for every candidate. Columns: candidate, mean, square, rows.

    All candidates are answered by one pass over the rows, unless a step behind the replaced columns needs the whole
    table: then there is one aggregate per candidate, ``PER_JOB`` of them in a job.
    """
    if prepare is not None:
        before, after = prepare.split_at(candidates.columns)
        df = before(df)
        if not after.row_wise():
            return _averaged_responses(stored(df, "prepared"), model, target, candidates, logged, after)
        if after.steps:
            return _unfolded_responses(df, model, target, candidates, logged, after)
        df = after(df)
    if isinstance(model, LinearRegressor):
        return _linear_responses(df, model, target, candidates, logged)
    return _general_responses(df, model, target, candidates, logged)


def _linear_parts(df, model, target, columns, logged) -> tuple[DataFrame, np.ndarray]:
    """One row of averages of what the replaced columns leave alone, and the weights of the replaced columns."""
    ready = model.ready(df)
    weights = dict(zip(model.features, model.weights[target]))
    rest = reduce(
        operator.add, [F.lit(w) * filled(ready, c) for c, w in weights.items() if c not in set(columns)],
        F.lit(model.intercepts[target]),
    )
    # y = rest + step per row and candidate; with logs y = exp(rest) * exp(step) - 1
    part = F.exp(rest) if logged else rest
    facts = ready.agg(F.avg(part).alias("a"), F.avg(part * part).alias("b"), F.count(F.lit(1)).alias("rows"))
    return facts, np.array([weights.get(c, 0.0) for c in columns], float)


def _linear_responses(df, model, target, candidates, logged) -> DataFrame:
    facts, weights = _linear_parts(df, model, target, candidates.columns, logged)
    table = candidates.table(df.sparkSession)
    step = reduce(
        operator.add, [F.lit(float(w)) * F.coalesce(F.nanvl(q(c), F.lit(0.0)), F.lit(0.0)) for c, w in zip(candidates.columns, weights)],
        F.lit(0.0),
    )
    joined = table.withColumn("_step", step).join(F.broadcast(facts))
    if logged:
        k = F.exp("_step")
        mean = F.col("a") * k - 1
        square = F.col("b") * k * k - 2 * F.col("a") * k + 1
    else:
        mean = F.col("a") + F.col("_step")
        square = F.col("b") + 2 * F.col("a") * F.col("_step") + F.col("_step") * F.col("_step")
    return joined.select("candidate", mean.alias("mean"), square.alias("square"), "rows")


def _general_responses(df, model, target, candidates, logged) -> DataFrame:
    """For other models: a function of matrices where the model has one, else its own table form."""
    function = evaluator(model)
    if function is None:
        return _unfolded_responses(df, model, target, candidates, logged, Chain(()))
    count = candidates.count
    acc = _evaluated(df, model, function, target, candidates, logged, each=True)
    means, squares, rows = acc[:count], acc[count:2 * count], acc[-1]
    table = [(i, float(m / rows) if rows else None, float(s / rows) if rows else None, int(rows)) for i, (m, s) in enumerate(zip(means, squares))]
    return df.sparkSession.createDataFrame(table, "candidate int, mean double, square double, rows bigint")


def _evaluated(df, model, function, target, candidates, logged, each: bool) -> np.ndarray:
    """Sums of predictions and of their squares, per candidate or over all, and the number of rows, in one pass.

    Rows that agree in all columns that the model reads are counted first. A task walks through the candidates in blocks
    and hands back sums only.
    """
    ready = model.ready(df)
    others = [c for c in inputs(model) if c not in candidates.columns and c in ready.columns]
    combos = ready.select(*[filled(ready, c).alias(f"o{i}") for i, c in enumerate(others)]).groupBy(
        *[f"o{i}" for i in range(len(others))]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    count = candidates.count

    def sums(matrix: np.ndarray) -> np.ndarray:
        weight, rows = matrix[:, 0], len(matrix)
        out = np.zeros(2 * count + 1 if each else 3)
        out[-1] = weight.sum()
        block = max(1, EVALUATED // rows)
        for low in range(0, count, block):
            tried = np.nan_to_num(candidates.block(low, low + block), nan=0.0, posinf=np.inf, neginf=-np.inf)
            columns = {c: np.tile(matrix[:, 1 + i], len(tried)) for i, c in enumerate(others)}
            columns |= {c: np.repeat(tried[:, i], rows) for i, c in enumerate(candidates.columns)}
            p = function(columns)[target]
            p = np.expm1(p) if logged else p
            p = np.broadcast_to(p, len(tried) * rows).reshape(len(tried), rows)
            if each:
                out[low:low + len(tried)] = p @ weight
                out[count + low:count + low + len(tried)] = (p * p) @ weight
            else:
                out[0] += (p @ weight).sum()
                out[1] += ((p * p) @ weight).sum()
        return out

    packed_rows = combos.select(F.array("n", *[F.col(f"o{i}") for i in range(len(others))]).alias("_x"))
    return partial_sums(packed_rows, "_x", 1 + len(others), sums, 2 * count + 1 if each else 3)


def _unfolded_responses(df, model, target, candidates, logged, after: Chain) -> DataFrame:
    """Every row takes every candidate's values on its way through row-wise steps and the model, in one pass.

    The rows unfold inside the tasks and are added up there; only sums per candidate are shuffled.
    """
    numbers = df.withColumn("_candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates.count - 1))))
    values = candidates.block(0, candidates.count)
    replaced = with_all(numbers, {c: F.get(lit_array(values[:, i].tolist()), F.col("_candidate")) for i, c in enumerate(candidates.columns)})
    done = model.transform(after(replaced))
    p = filled(done, prediction_name(target))
    p = F.expm1(p) if logged else p
    sums = done.groupBy(F.col("_candidate").alias("candidate")).agg(
        F.avg(p).alias("mean"), F.avg(p * p).alias("square"), F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(candidates.count).select(F.col("id").cast("int").alias("candidate"))
    return every.join(sums, "candidate", "left").select("candidate", "mean", "square", F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"))


def _averaged_responses(table, model, target, candidates, logged, after=None) -> DataFrame:
    """Weighted averages over a stored table (weight ``_n`` when it has one), some candidates per job."""
    weight = F.col("_n") if "_n" in table.columns else F.lit(1)
    rows: list = []
    settings = list(enumerate(candidates.settings()))
    for at in range(0, len(settings), PER_JOB):
        parts = []
        for i, setting in settings[at:at + PER_JOB]:
            replaced = with_all(table, {c: F.lit(float(v)) for c, v in setting.items()})
            done = model.transform(after(replaced) if after is not None else replaced)
            p = q(prediction_name(target))
            p = F.expm1(p) if logged else p
            parts.append(done.agg(
                F.lit(i).alias("candidate"), (F.sum(p * weight) / F.sum(weight)).alias("mean"),
                (F.sum(p * p * weight) / F.sum(weight)).alias("square"), F.sum(weight).cast("bigint").alias("rows"),
            ))
        rows += [tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()]
    return table.sparkSession.createDataFrame(rows, "candidate int, mean double, square double, rows bigint")


def objective(mean: Column, maximize: bool) -> Column:
    return F.try_divide(F.lit(1.0), mean) if maximize else mean


def best_of_rounds(responses: DataFrame, draws: int = DRAWS, maximize: bool = True) -> DataFrame:
    """The best draw of each round: smallest objective, first draw on a tie."""
    scored = responses.select(
        (F.col("candidate") / F.lit(draws)).cast("int").alias("round"), "candidate",
        objective(F.col("mean"), maximize).alias("metric"),
    )
    order = Window.partitionBy("round").orderBy("metric", "candidate")
    return scored.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def recommend(
    df: DataFrame, model: Regressor, target: str, spaces: Mapping[str, tuple[float, float]] | Sequence[str],
    maximize: bool = True, logged: bool = False, rounds: int = ROUNDS, draws: int = DRAWS, seed: int = 42,
    candidates: Candidates | None = None, prepare: Chain | None = None,
) -> DataFrame:
    """Recommended values, one row: weighted mean of the round winners.

    A winner weighs more the closer its objective is to the best one and the closer its value is to
    the mean of all winners.
    """
    if not isinstance(spaces, Mapping):
        spaces = {c: DEFAULT_SPACE for c in spaces}
    candidates = candidates or random_candidates(spaces, rounds * draws, seed)
    responses = mean_responses(df, model, target, candidates, logged, prepare)
    winners = best_of_rounds(responses, draws, maximize).join(candidates.table(df.sparkSession), "candidate")
    return weighted_winners(winners, candidates.columns)


def weighted_winners(winners: DataFrame, columns: Sequence[str]) -> DataFrame:
    everything = F.array(*[q(c) for c in columns])
    facts = winners.agg(
        F.min("metric").alias("_best"), *[F.avg(q(c)).alias(f"_mean_{c}") for c in columns]
    ).join(F.broadcast(winners.select(F.explode(everything).alias("v")).agg(F.var_pop("v").alias("_var"))))
    near = -F.pow(F.col("_best") - F.col("metric"), F.lit(2.0)) / F.lit(LIKELIHOOD_WIDTH)
    joined = winners.join(F.broadcast(facts))

    def weight(c: str) -> Column:
        away = F.pow(q(f"_mean_{c}") - q(c), F.lit(2.0))
        return F.exp(near - F.coalesce(F.try_divide(away, F.col("_var")), F.lit(0.0)))

    return joined.agg(*[(F.sum(weight(c) * q(c)) / F.sum(weight(c))).alias(c) for c in columns])


def recommend_by_objective(
    df: DataFrame, model: Regressor, target: str, columns: Sequence[str],
    spaces: Mapping[str, tuple[float, float]] | None = None, maximize: bool = True, logged: bool = False,
    count: int = EVALUATIONS, candidates: Candidates | None = None, prepare: Chain | None = None,
) -> DataFrame:
    """Best of evenly spread candidates under an objective that also rewards uneven settings, one row.

    Ranges that are not given follow from mean and spread of the target.
    """
    spaces = dict(spaces or {})
    missing = [c for c in columns if c not in spaces]
    if missing and candidates is None:
        row = search_range(df, target).first()
        if row["low"] is None:
            raise ValueError(f"{target} has no values; give search ranges")
        spaces.update({c: (row["low"], row["high"]) for c in missing})
    candidates = candidates or even_candidates({c: spaces[c] for c in columns}, count)
    responses = mean_responses(df, model, target, candidates, logged, prepare)
    return objective_table(responses, candidates, df.sparkSession, maximize).orderBy("objective", "candidate").limit(1)


def objective_table(responses: DataFrame, candidates: Candidates, spark, maximize: bool) -> DataFrame:
    """Objective of every candidate: (0.7 + 0.3 * evenness) times the mean, or divided by it."""
    values = [q(c) for c in candidates.columns]
    # mean of c c^T / column-wise sums of squares for a single row c
    total = reduce(operator.add, values)
    inverse = reduce(operator.add, [F.coalesce(F.try_divide(F.lit(1.0), v), F.lit(0.0)) for v in values])
    filled_columns = reduce(operator.add, [F.when(v != 0, 1.0).otherwise(0.0) for v in values])
    # a setting of 0 has no ratio to it and is left out, as a mean that skips gaps does
    evenness = F.try_divide(total * inverse, F.lit(float(len(values))) * filled_columns)
    factor = F.lit(PLAIN_SHARE) + F.lit(SPREAD_SHARE) * evenness
    value = F.try_divide(factor, F.col("mean")) if maximize else factor * F.col("mean")
    return responses.join(candidates.table(spark), "candidate").select(
        "candidate", *values, "mean", value.alias("objective")
    )


def analyze_options(
    df: DataFrame, model: Regressor, fields: Mapping[str, Sequence[float]], normalized: Sequence[str] = (),
    logged: bool = False, prepare: Chain | None = None,
) -> DataFrame:
    """Spread of predictions when a group of columns takes every combination of options on every row.

    ``fields`` maps a part of column names to the options. One row per field and target: variance,
    deviation and mean over all rows and combinations.
    """
    parts = []
    for part, options in fields.items():
        columns = containing(df, part)
        if not columns:
            continue
        candidates = option_candidates(columns, options, part in normalized)
        for t in model.targets:
            mean, square = _overall(df, model, t, candidates, logged, prepare)
            var = square - mean * mean
            parts.append(df.sparkSession.range(1).select(
                F.lit(part.rstrip("_")).alias("field"), F.lit(t).alias("target"), F.lit(candidates.count).cast("bigint").alias("combinations"),
                F.greatest(F.lit(var), F.lit(0.0)).alias("var"), F.sqrt(F.greatest(F.lit(var), F.lit(0.0))).alias("std"), F.lit(mean).alias("mean"),
            ))
    if not parts:
        raise ValueError("no column matches any field")
    return reduce(DataFrame.unionByName, parts)


def _overall(df, model, target, candidates, logged, prepare) -> tuple[float, float]:
    """Mean and mean square of the predictions over all rows and candidates, without a row per candidate."""
    if prepare is None and isinstance(model, LinearRegressor):
        facts, step = _linear_parts(df, model, target, candidates.columns, logged)
        row = facts.first()
        a, b = row["a"] or 0.0, row["b"] or 0.0
        total = square = 0.0
        for low in range(0, candidates.count, EVALUATED):
            moved = np.nan_to_num(candidates.block(low, low + EVALUATED), nan=0.0, posinf=np.inf, neginf=-np.inf) @ step
            if logged:
                k = np.exp(moved)
                total += float((a * k - 1).sum())
                square += float((b * k * k - 2 * a * k + 1).sum())
            else:
                total += float((a + moved).sum())
                square += float((b + 2 * a * moved + moved * moved).sum())
        return total / candidates.count, square / candidates.count
    function = evaluator(model) if prepare is None else None
    if function is not None:
        acc = _evaluated(df, model, function, target, candidates, logged, each=False)
        return float(acc[0] / acc[2] / candidates.count), float(acc[1] / acc[2] / candidates.count)
    row = mean_responses(df, model, target, candidates, logged, prepare).agg(F.avg("mean"), F.avg("square")).first()
    return row[0], row[1]


def option_samples(df: DataFrame, model: Regressor, part: str, options: Sequence[float], target: str,
                   normalize: bool = False, logged: bool = False) -> DataFrame:
    """The single combinations with their mean response."""
    candidates = option_candidates(containing(df, part), options, normalize)
    return mean_responses(df, model, target, candidates, logged).join(
        candidates.table(df.sparkSession), "candidate"
    )


def leaderboard(
    df: DataFrame, candidates: Sequence[Regressor], split: str, score: metrics.Score = metrics.r2,
    maximize: bool = True, first_run: int = 0,
) -> tuple[DataFrame, Regressor]:
    """Fit every candidate on the training rows, score both sides, keep the best on the valid side.

    Linear candidates with the same columns share one pass for their sums.
    """
    from loomwright.plans.moments import moments

    spark = df.sparkSession
    train_rows = df.where(q(split) == "train")
    shared: dict[tuple, object] = {}
    rows, best = [], None
    for run, candidate in enumerate(candidates, first_run):
        if isinstance(candidate, LinearRegressor):
            names = (candidate.features, candidate.targets)
            if names not in shared:
                shared[names] = moments(candidate.ready(train_rows), [*dict.fromkeys([*names[0], *names[1]])])
            fitted = candidate.from_moments(shared[names])
        else:
            fitted = candidate.fit(train_rows)
        found = {r[split]: r for r in fitted.scores(df, score, [split]).collect()}
        train_score = float(np.nanmean([found["train"][t] for t in fitted.targets]))
        valid_score = float(np.nanmean([found["valid"][t] for t in fitted.targets]))
        settings = ", ".join(f"{k}={v}" for k, v in describe(candidate).items())
        rows.append((run, settings, list(fitted.targets), train_score, valid_score))
        if best is None or (valid_score > best[0]) == maximize and valid_score != best[0]:
            best = (valid_score, fitted)
    board = spark.createDataFrame(
        rows, "run int, settings string, targets array<string>, train_score double, valid_score double"
    )
    return board, best[1]


def describe(candidate: Regressor) -> dict[str, object]:
    plain = (int, float, str, bool)
    return {"model": type(candidate).__name__} | {
        k: v for k, v in vars(candidate).items() if isinstance(v, plain)
    }


def best_run(board: DataFrame, metric: str, maximize: bool = True, run: str = "run") -> DataFrame:
    """The run that is best by metric; the earlier run on a tie."""
    order = F.desc_nulls_last(metric) if maximize else F.asc_nulls_last(metric)
    return board.orderBy(order, run).limit(1)

