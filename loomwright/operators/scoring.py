"""Routed prediction and the training job around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import mathops
from loomwright.operators import metrics
from loomwright.operators.aggregate import GroupRows
from loomwright.operators.models import Regressor, prediction_name
from loomwright.operators.select import FillEmptyGroups, drop_superseded, mark_split, route
from loomwright.plans.columns import filled, q
from loomwright.plans.operator import Chain, Operator

# Fixed value: rows of no creative go to the second model.
DEFAULT_ROUTE = {"creative_id": 0}
# Flag groups that may not be all off before training.
FLAG_GROUPS = ("goal_type_", "device_type_", "os_targets_", "browser_targets_", "language_", "ad_types_")
COUNT = "_n_rows"


@dataclass(frozen=True)
class RoutedPrediction(Operator):
    """Prepare rows, score each with the model its route names, undo logs, scale means back to sums.

    Both scores are columns of one plan and the route picks between them. When the preparation
    aggregates rows, the group size travels along and averaged targets are multiplied by it. With ``prepare_other`` the
    rows of the second model are told by the route before anything is prepared, and have a preparation of their own.
    """

    model: Regressor
    targets: tuple[str, ...]
    prepare: Chain = field(default_factory=lambda: Chain(()))
    other: Regressor | None = None
    prepare_other: Chain | None = None
    criteria: Mapping[str, object] = field(default_factory=lambda: dict(DEFAULT_ROUTE))
    average_prediction: bool = True

    def grouping(self) -> GroupRows | None:
        return next((s for s in self.prepare.steps if isinstance(s, GroupRows)), None)

    def counted(self) -> Chain:
        steps = tuple(
            replace(s, count_column=COUNT) if s is self.grouping() else s for s in self.prepare.steps
        )
        return replace(self.prepare, steps=steps, features=self.model.features, fill=True)

    def prepared(self, df: DataFrame) -> DataFrame:
        return self.counted()(df)

    def sides(self, df: DataFrame) -> tuple[tuple[RoutedPrediction, DataFrame], tuple[RoutedPrediction, DataFrame]]:
        """Either model with its own preparation, and the rows that its route names."""
        way = F.coalesce(route({c: v for c, v in self.criteria.items() if c in df.columns}), F.lit(False))
        first = replace(self, other=None, prepare_other=None)
        return (first, df.where(~way)), (replace(first, model=self.other, prepare=self.prepare_other), df.where(way))

    def apart(self) -> bool:
        return self.other is not None and self.prepare_other is not None

    def fit(self, df: DataFrame) -> RoutedPrediction:
        if self.apart():
            one, two = (flow.fit(rows) for flow, rows in self.sides(df))
            return replace(self, model=one.model, prepare=one.prepare, other=two.model, prepare_other=two.prepare)
        chain = self.counted().fit(df)
        ready = chain(df)
        other = self.other.fit(ready) if self.other is not None else None
        return replace(self, prepare=chain, model=self.model.fit(ready), other=other)

    def scored(self, ready: DataFrame) -> DataFrame:
        """Rows with one column ``_score_<target>`` from the model of their route."""
        kept = ready.columns
        first = self.model.transform(ready)
        named = first.select(*[q(c) for c in kept], *[
            q(prediction_name(t)).alias(f"_first_{t}") for t in self.targets
        ])
        if self.other is None:
            return named.select(*[q(c) for c in kept], *[q(f"_first_{t}").alias(f"_score_{t}") for t in self.targets])
        second = self.other.transform(named)
        way = route({c: v for c, v in self.criteria.items() if c in ready.columns})
        return second.select(*[q(c) for c in kept], *[
            F.when(way, q(prediction_name(t))).otherwise(q(f"_first_{t}")).alias(f"_score_{t}") for t in self.targets
        ])

    def transform(self, df: DataFrame) -> DataFrame:
        if self.apart():
            one, two = (flow.transform(rows) for flow, rows in self.sides(df))
            return one.unionByName(two, allowMissingColumns=True)
        ready = self.prepared(df)
        grouping = self.grouping()
        means = set(grouping.averaged(df)) if grouping is not None else set()
        scored = self.scored(ready)
        outputs = {}
        for t in self.targets:
            name, value = t, q(f"_score_{t}")
            if t.startswith("log_"):
                name, value = t.removeprefix("log_"), mathops.unlog(value)
            if grouping is not None and self.average_prediction and {t, name} & means:
                value = value * q(COUNT)
            outputs[name] = value
        old = [*outputs, *self.targets]
        rest = [c for c in drop_superseded(ready, old).columns if c != COUNT]
        return scored.select(*[q(c) for c in rest], *[e.alias(n) for n, e in outputs.items()])


@dataclass(frozen=True)
class Trained:
    """What a training job returns."""

    flow: RoutedPrediction
    scores: DataFrame
    leaderboard: DataFrame | None = None


def train(
    rows: DataFrame,
    model: Regressor,
    keys: Sequence[str],
    prepare: Sequence[Operator] = (),
    valid: DataFrame | None = None,
    flag_groups: Sequence[str] = FLAG_GROUPS,
    candidates: Sequence[Regressor] = (),
    train_share: float = 0.8,
    seed: int = 42,
) -> Trained:
    """Split, switch on empty flag groups, prepare, search if asked, fit, validate.

    ``keys`` identify a row and decide its side of the split when no validation rows are given.
    """
    if valid is None:
        marked = mark_split(rows, keys, train_share, seed)
    else:
        marked = rows.withColumn("split", F.lit("train")).unionByName(
            valid.withColumn("split", F.lit("valid")), allowMissingColumns=True
        )
    marked = FillEmptyGroups(tuple(flag_groups)).transform(marked)
    train_rows = marked.where(q("split") == "train")
    chain = Chain(tuple(prepare), tuple(model.features), True).fit(train_rows)
    ready = chain(marked)
    board = None
    if candidates:
        from loomwright.operators.search import leaderboard

        board, model = leaderboard(ready, list(candidates), "split")
    else:
        model = model.fit(ready.where(q("split") == "train"))
    done = model.transform(ready)
    table = done.groupBy("split").agg(*[
        e for t in model.targets for e in (
            metrics.r2(filled(done, t), filled(done, prediction_name(t))).alias(f"r2_{t}"),
            metrics.mse(filled(done, t), filled(done, prediction_name(t))).alias(f"mse_{t}"),
        )
    ])
    return Trained(RoutedPrediction(model, tuple(model.targets), chain, criteria={}), table, board)
