"""Row-wise feature operators: calendar, factors, logs, curves, text and JSON columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import arrays, calendar, jsoncols, mathops, text
from loomwright.plans.columns import NUMBERS, filled, known, lit_array, number, q, type_of, with_all
from loomwright.plans.operator import Operator

TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def as_moment(df: DataFrame, column: str) -> Column | None:
    """A time column as it is, text parsed; None when the type cannot hold a time."""
    kind = type_of(df, column)
    if isinstance(kind, TIMES):
        return q(column)
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(q(column)).cast("timestamp_ntz")
    return None


def short_name(column: str, columns: Sequence[str], field: str) -> str:
    return field if len(columns) <= 1 else "_".join(column.split("_")[:-1]) + f"_{field}"


@dataclass(frozen=True)
class WeekdayName(Operator):
    """English day names; the source columns become time stamps."""

    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            moment = as_moment(df, c)
            if moment is not None:
                new[c] = moment
                new[short_name(c, self.columns, "weekday")] = calendar.weekday_name(moment)
        return with_all(df, new)


@dataclass(frozen=True)
class SeasonField(Operator):
    """A calendar field of each column, or its English name where there is one."""

    columns: tuple[str, ...]
    season: str = "month"
    naming: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            moment = as_moment(df, c)
            if moment is None:
                continue
            new[c] = moment
            if self.naming and self.season in calendar.NAME_FORMATS:
                new[short_name(c, self.columns, self.season)] = calendar.name(self.season, moment)
            elif not self.naming and self.season in calendar.FIELDS:
                new[short_name(c, self.columns, self.season)] = calendar.field(self.season, moment)
        return with_all(df, new)


@dataclass(frozen=True)
class SineTime(Operator):
    """``<c>_num_cont``: sine with one period per ``peak``, which defaults to the largest value + 1.

    A column that is missing or holds no numbers is derived from ``time_column`` by its name.
    """

    columns: tuple[str, ...]
    peaks: Mapping[str, float] | None = None
    time_column: str = "event_date"

    def value(self, df: DataFrame, column: str) -> Column | None:
        if column in df.columns and isinstance(type_of(df, column), NUMBERS):
            return known(q(column), type_of(df, column))
        if column in df.columns and column not in calendar.FIELDS and isinstance(type_of(df, column), T.StringType):
            return q(column).try_cast("double")
        if column in calendar.FIELDS and self.time_column in df.columns:
            moment = as_moment(df, self.time_column)
            return None if moment is None else calendar.field(column, moment)
        return None

    def fit(self, df: DataFrame) -> SineTime:
        peaks = dict(self.peaks or {})
        values = {c: self.value(df, c) for c in self.columns if c not in peaks}
        values = {c: v for c, v in values.items() if v is not None}
        if values:
            row = df.agg(*[F.max(v).alias(f"p{i}") for i, v in enumerate(values.values())]).first()
            peaks.update({c: float(m) + 1 for c, m in zip(values, row) if m is not None})
        return replace(self, peaks=peaks)

    def transform(self, df: DataFrame) -> DataFrame:
        values = {c: self.value(df, c) for c in self.columns}
        return with_all(df, {
            f"{c}_num_cont": calendar.wave(v, (self.peaks or {})[c])
            for c, v in values.items() if v is not None and c in (self.peaks or {})
        })


@dataclass(frozen=True)
class Factors(Operator):
    """Columns times fixed weights plus a bias; in place, or into ``<c><suffix>`` when one is given."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float | None = None
    normalize: bool = True
    bias_in_factors: bool = True
    default: float = 0.0
    suffix: str | None = None

    def used(self) -> tuple[list[float], float]:
        weights = self.weights if len(self.weights) > 1 else self.weights * len(self.columns)
        if len(weights) != len(self.columns):
            raise ValueError("one weight, or one per column")
        return mathops.factors(weights, self.bias, self.normalize, self.bias_in_factors)

    def names(self) -> list[str]:
        return [f"{c}{self.suffix}" if self.suffix else c for c in self.columns]

    def transform(self, df: DataFrame) -> DataFrame:
        weights, bias = self.used()
        source = {c: number(df, c) if c in df.columns else F.lit(float(self.default)) for c in self.columns}
        return with_all(df, {
            n: source[c] * F.lit(w) + F.lit(bias) for n, c, w in zip(self.names(), self.columns, weights)
        })

    def inverse(self, df: DataFrame) -> DataFrame:
        weights, bias = self.used()
        return with_all(df, {
            c: F.try_divide(number(df, n) - F.lit(bias), F.lit(w))
            for n, c, w in zip(self.names(), self.columns, weights)
        })


def uniform_factors(columns: Sequence[str], bias: float = 0.0, **settings) -> Factors:
    return Factors(tuple(columns), (1.0 / len(columns),) * len(columns), bias, **settings)


def cosine_factors(columns: Sequence[str], peak_at: float | None = None, bias: float | None = None, **settings) -> Factors:
    return Factors(tuple(columns), tuple(calendar.cosine_factors(len(columns), peak_at)), bias, **settings)


@dataclass(frozen=True)
class SignedLog(Operator):
    columns: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: mathops.signed_log(number(df, c)) for c in self.columns})


@dataclass(frozen=True)
class UnlogColumns(Operator):
    """Every ``log_x`` column replaced by ``x``."""

    def transform(self, df: DataFrame) -> DataFrame:
        logs = [c for c in df.columns if c.startswith("log_")]
        new = {c.removeprefix("log_"): mathops.unlog(q(c).cast("double")) for c in logs}
        return with_all(df, new).drop(*logs)


@dataclass(frozen=True)
class BumpedOneHot(Operator):
    """Flags of one category as a bump around the active one, ``<c>_gau``.

    Rows without exactly one active flag get NULL.
    """

    columns: tuple[str, ...]
    points: tuple[float, ...] | None = None
    sigma: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        size = len(self.columns)
        points = list(self.points) if self.points is not None else [k - size // 2 for k in range(size)]
        sigma = self.sigma if self.sigma is not None else len(points) * 1.1 / 7
        rows = [mathops.bump_values(points, hot - size // 2, sigma) for hot in range(size)]
        flags = [F.coalesce(q(c).cast("boolean"), F.lit(False)) for c in self.columns]
        active = reduce(lambda a, b: a + b, [f.cast("int") for f in flags])
        hot = F.when(active == 1, F.coalesce(*[F.when(f, F.lit(k)) for k, f in enumerate(flags)]))
        marked = df.withColumn("_hot", hot)
        return with_all(marked, {
            f"{c}_gau": F.get(lit_array([row[k] for row in rows]), F.col("_hot")) for k, c in enumerate(self.columns)
        }).drop("_hot")


@dataclass(frozen=True)
class Polynomial(Operator):
    """All monomials of the columns up to a degree, ``poly_<name>``; missing values count as 0."""

    columns: tuple[str, ...]
    degree: int = 2
    include_bias: bool = True
    interaction_only: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        terms = mathops.monomials(self.columns, self.degree, self.include_bias, self.interaction_only)
        return with_all(df, {
            f"poly_{name}": reduce(lambda a, b: a * b, [filled(df, c) for c in parts], F.lit(1.0))
            for name, parts in terms
        })


@dataclass(frozen=True)
class ScaledColumn(Operator):
    """A column times a rate under a new name, such as an amount in another currency."""

    column: str
    name: str = "booked_revenue_usd"
    # Fixed value: default exchange rate.
    rate: float = 1.0733

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {self.name: number(df, self.column) * F.lit(self.rate)})


@dataclass(frozen=True)
class ReferenceCurve(Operator):
    column: str
    name: str
    coefficients: tuple[float, ...]
    cut: float | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {self.name: mathops.polynomial(number(df, self.column), self.coefficients, self.cut)})


@dataclass(frozen=True)
class DeviceTypes(Operator):
    columns: tuple[str, ...] = ("device_type",)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {c: text.device_types(q(c)) for c in self.columns})


@dataclass(frozen=True)
class CanonicalNames(Operator):
    """List elements by the first known name they contain."""

    column: str
    known: tuple[str, ...] = text.BROWSERS
    cuts: tuple[str, ...] = text.BROWSER_CUTS

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {self.column: text.canonical_names(q(self.column), self.cuts, self.known)})


@dataclass(frozen=True)
class JoinTexts(Operator):
    columns: tuple[str, ...]
    name: str = "text"

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {self.name: text.joined([q(c) for c in self.columns])})


@dataclass(frozen=True)
class TypedTexts(Operator):
    """Parallel JSON lists of types and texts as one column ``native_<type>`` per wanted type."""

    types_column: str = "native_text_types"
    texts_column: str = "native_texts"
    wanted: tuple[str, ...] = ("title", "description", "call_to_action")

    def transform(self, df: DataFrame) -> DataFrame:
        kinds = [w.replace("native_", "") for w in self.wanted]
        return with_all(df, {
            f"native_{k}": jsoncols.typed_text(q(self.types_column), q(self.texts_column), k) for k in kinds
        })


@dataclass(frozen=True)
class AgeTargets(Operator):
    """Age target JSON as a flag and two lists of range ends."""

    column: str = "age_targets"
    only: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        flag, lows, highs = jsoncols.age_targets(q(self.column))
        new = {f"{self.column}_allow_unknown": flag, f"{self.column}_lows": lows, f"{self.column}_highs": highs}
        return df.select(*[e.alias(n) for n, e in new.items()]) if self.only else with_all(df, new)


@dataclass(frozen=True)
class AgeHistogram(Operator):
    """Range lists as ``age_hist_<k>`` columns."""

    columns: tuple[str, str] = ("age_targets_lows", "age_targets_highs")
    normalize: bool = True
    bins: int = 12
    low: int = 1
    high: int = 120
    order: int = 2

    def transform(self, df: DataFrame) -> DataFrame:
        hist = arrays.age_histogram(
            q(self.columns[0]), q(self.columns[1]), self.normalize, self.bins, self.low, self.high, self.order
        )
        packed = df.withColumn("_hist", hist)
        new = [F.get("_hist", F.lit(k)).alias(f"age_hist_{k}") for k in range(self.bins)]
        return packed.select(*[q(c) for c in df.columns], *new)


@dataclass(frozen=True)
class LineItemIds(Operator):
    column: str = "line_items"
    name: str = "LIs"

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {self.name: jsoncols.object_ids(q(self.column))}) if self.column in df.columns else df


@dataclass(frozen=True)
class ParseLists(Operator):
    """JSON list text as lists, re-encoded videos taken out."""

    columns: tuple[str, ...]
    element: str = "string"

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            if isinstance(type_of(df, c), T.StringType):
                parsed = jsoncols.json_list(q(c), self.element)
                new[c] = text.playable_videos(parsed) if self.element == "string" else parsed
        return with_all(df, new)


@dataclass(frozen=True)
class FlattenJson(Operator):
    """A JSON object column as one column per nested field (dotted names); the source is dropped.

    The fields are found by merging the inferred types of all rows; whole numbers are bigint, fractions double, what
    is mixed or never filled is text. Listed objects give ``<c>_<i>.<field>`` columns up to the longest list. ``schema`` is
    a type as JSON or DDL text.
    """

    column: str
    listed: bool = False
    schema: str | None = None
    longest: int | None = None

    whole_table = False

    def text(self) -> Column:
        return jsoncols.text_or(q(self.column), "[]" if self.listed else "{}")

    def needs_fit(self) -> bool:
        return self.schema is None or (self.listed and self.longest is None)

    def facts(self) -> list[Column]:
        longest = F.max(F.size(F.try_variant_get(F.try_parse_json(self.text()), "$", "array<variant>")))
        return [jsoncols.shape_of(self.text()), longest if self.listed else F.lit(None).cast("int")]

    def stated(self, shape: str | None, longest: int | None) -> FlattenJson:
        return replace(self, schema=jsoncols.shape_type(shape).json(), longest=max(0, longest or 0) if self.listed else None)

    def fit(self, df: DataFrame) -> FlattenJson:
        return self.stated(*df.agg(*self.facts()).first()) if self.needs_fit() else self

    def kind(self) -> T.DataType:
        given = self.schema.strip()
        return T._parse_datatype_json_string(given) if given[:1] in '{"' else T._parse_datatype_string(given)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.needs_fit():
            raise ValueError("fit first")
        kept = [q(c) for c in df.columns if c != self.column]
        kind = self.kind()
        inner = kind.elementType if self.listed and isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StructType):
            return df.select(*kept)
        parsed = df.withColumn("_json", F.from_json(self.text(), kind))
        if self.listed:
            fields = [
                e.alias(f"{self.column}_{i}.{n}")
                for i in range(self.longest or 0) for n, e in leaves(F.get("_json", F.lit(i)), inner)
            ]
        else:
            fields = [e.alias(n) for n, e in leaves(F.col("_json"), inner)]
        return parsed.select(*kept, *fields)


def leaves(value: Column, kind: T.DataType, prefix: str = "") -> list[tuple[str, Column]]:
    if not isinstance(kind, T.StructType):
        return [(prefix, value)]
    return [
        leaf for f in kind.fields
        for leaf in leaves(value.getField(f.name), f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    ]


@dataclass(frozen=True)
class DecodeText(Operator):
    """Text columns that hold JSON or lists, decoded; columns to decode are those whose filled cells all parse.

    Where all filled cells are JSON objects or JSON lists, the column gets their merged type: a struct, or an array of what the
    lists hold. Quoted and comma-separated lists, alone or beside JSON lists, become lists of texts. ``kinds`` are the types
    of the JSON columns as JSON text.
    """

    columns: tuple[str, ...] | None = None
    kinds: Mapping[str, str] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> DecodeText:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (self.columns is None or f.name in self.columns)]
        if not texts:
            return self if self.columns is not None else replace(self, columns=())
        facts = []
        for i, c in enumerate(texts):
            nested = q(c).rlike(r"^\s*[\[{]") & F.try_parse_json(q(c)).isNotNull()
            facts += [F.count(q(c)).alias(f"n{i}"), F.count_if(nested).alias(f"j{i}"), F.count_if(jsoncols.string_list(q(c)).isNotNull()).alias(f"t{i}"),
                      jsoncols.shape_of(F.when(nested, q(c))).alias(f"s{i}")]
        row = df.agg(*facts).first()
        kinds = {}
        for i, c in enumerate(texts):
            kind = jsoncols.shape_type(row[f"s{i}"])
            if row[f"n{i}"] and row[f"j{i}"] == row[f"n{i}"] and isinstance(kind, (T.ArrayType, T.StructType)):
                kinds[c] = kind.json()
        listed = tuple(c for i, c in enumerate(texts) if c in kinds or (row[f"n{i}"] and row[f"t{i}"] == row[f"n{i}"]))
        return replace(self, columns=listed if self.columns is None else self.columns, kinds=kinds)

    def transform(self, df: DataFrame) -> DataFrame:
        return with_all(df, {
            c: F.from_json(q(c), T._parse_datatype_json_string(self.kinds[c])) if c in self.kinds else jsoncols.string_list(q(c))
            for c in self.columns or ()
        })


def flatten_many(df: DataFrame, objects: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Flatten every named column that is there, all fitted in one pass; absent ones are skipped."""
    steps = [FlattenJson(c, listed) for c, listed in [*((c, False) for c in objects), *((c, True) for c in lists)] if c in df.columns]
    if not steps:
        return df
    facts = [e.alias(f"f{i}_{k}") for i, step in enumerate(steps) for k, e in enumerate(step.facts())]
    row = df.agg(*facts).first()
    for i, step in enumerate(steps):
        df = step.stated(row[f"f{i}_0"], row[f"f{i}_1"])(df)
    return df
