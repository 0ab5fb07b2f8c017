"""The operator protocol.

An operator is a frozen dataclass. ``fit`` reads the data it needs with aggregate jobs and
returns an operator whose fields hold the result; ``transform`` is lazy and never triggers a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields
from functools import reduce
from typing import Any, ClassVar

from pyspark.sql import DataFrame


class BatchOnly(ValueError):
    """Raised when an operator that needs the whole table is handed a stream."""


@dataclass(frozen=True)
class Operator:
    kinds: ClassVar[dict[str, type]] = {}
    whole_table: ClassVar[bool] = False
    #: fields that hold code which a fitted operator (field ``fitted``) can do without
    needed_to_fit: ClassVar[tuple[str, ...]] = ()

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        Operator.kinds[cls.__name__] = cls

    def fit(self, df: DataFrame) -> Operator:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.whole_table and df.isStreaming:
            raise BatchOnly(f"{type(self).__name__} needs the whole table and cannot run on a stream")
        return self.transform(df)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df)(df)

    def names(self) -> set[str]:
        """Every text in the fields, at any depth: names and parts of names of columns are among them."""
        found: set[str] = set()
        todo: list[Any] = [getattr(self, f.name) for f in fields(self)]
        while todo:
            value = todo.pop()
            if isinstance(value, str):
                found.add(value)
            elif isinstance(value, Operator):
                found |= value.names()
            elif isinstance(value, Mapping):
                todo += [*value.keys(), *value.values()]
            elif isinstance(value, (tuple, list, set, frozenset)):
                todo += value
        return found

    def row_wise(self) -> bool:
        """Whether each row is made from one row alone, whatever rows stand beside it."""
        return not self.whole_table

    def leaves_alone(self, columns: set[str]) -> bool:
        """Whether it can be told that these columns are neither read nor changed nor added up.

        A step that works on whole tables may gather columns that it does not name, and one that names none may work on all.
        """
        named = self.names()
        return self.row_wise() and bool(named) and not any(name in c for c in columns for name in named)


@dataclass(frozen=True)
class Apply(Operator):
    """Any ``DataFrame -> DataFrame`` function as an operator."""

    function: Callable[[DataFrame], DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.function(df)

    def row_wise(self) -> bool:
        return False  # nothing is known of it


@dataclass(frozen=True)
class Chain(Operator):
    """Operators applied in order, then missing features as 0 and gaps filled."""

    steps: tuple[Operator, ...]
    features: tuple[str, ...] = ()
    fill: bool = False

    def fit(self, df: DataFrame) -> Chain:
        fitted = []
        for step in self.steps:
            step = step.fit(df)
            fitted.append(step)
            df = step(df)
        return Chain(tuple(fitted), self.features, self.fill)

    def transform(self, df: DataFrame) -> DataFrame:
        from loomwright.operators.select import FillMissing, MissingFeatures

        df = reduce(lambda frame, step: step(frame), self.steps, df)
        if self.features:
            df = MissingFeatures(tuple(self.features)).transform(df)
        if self.fill:
            df = FillMissing().transform(df)
        return df

    def row_wise(self) -> bool:
        return all(step.row_wise() for step in self.steps)

    def split_at(self, changed: Iterable[str]) -> tuple[Chain, Chain]:
        """Leading steps that leave ``changed`` columns alone, and the rest.

        The first part can run once, outside a loop that rewrites those columns.
        """
        changed = set(changed)
        for position, step in enumerate(self.steps):
            if not step.leaves_alone(changed):
                return Chain(self.steps[:position]), Chain(self.steps[position:], self.features, self.fill)
        return Chain(self.steps), Chain((), self.features, self.fill)
