"""Order statistics and running totals without one global sort task."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.plans.columns import lit_array, number
from loomwright.session import stored

LISTED_VALUES = 200_000
SKETCH = 10_000
CELLS = 2_048
RANGE_ROWS = 1_000_000


@dataclass(frozen=True)
class Bracket:
    """A closed range of values and the ranks wanted from it."""

    low: float
    high: float
    ranks: tuple[int, ...]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], listed: int = LISTED_VALUES, cells: int = CELLS,
) -> dict[str, list[float]]:
    """Exact quantiles, interpolated between neighbouring ranks; missing values are skipped."""
    found = ranked_values(df, columns, lambda n: [r for p in probs for r in _neighbours(p * (n - 1))], probs, listed, cells)
    result: dict[str, list[float]] = {}
    for c, (n, at) in found.items():
        places = [p * (n - 1) for p in probs]
        result[c] = [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) if n else None for x in places]
    return result


def _neighbours(place: float) -> tuple[int, int]:
    return math.floor(place), math.ceil(place)


def ranked_values(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]], probs: Sequence[float] | None = None,
    listed: int = LISTED_VALUES, cells: int = CELLS,
) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column the number of known values, and the values at the wanted ranks (from 0) in ascending order.

    ``ranks`` names the ranks for a number of values; ``probs`` says where to look first, if that is known beforehand.

    A sketch with a known error says between which two values each wanted rank must lie. Rows outside
    those brackets are only counted. Brackets are narrowed by counting cells until at most ``listed``
    rows are left in them; their values are then listed with counts. Every step is one scan for all columns together that
    shuffles counts by (column, bracket, cell), and what reaches the driver has a fixed bound.
    """
    columns = list(columns)
    numbers = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    slack = 2.0 / SKETCH
    around = sorted({min(1.0, max(0.0, p + d)) for p in probs or () for d in (-slack, slack)})
    facts = numbers.agg(*[
        F.struct(
            F.count(n).alias("n"), F.min(n).alias("low"), F.max(n).alias("high"),
            *([F.percentile_approx(n, around, SKETCH).alias("marks")] if around else []),
        ).alias(n) for n in numbers.columns
    ]).first()
    result: dict[str, tuple[int, dict[int, float]]] = {}
    searches: dict[int, Search] = {}
    share = max(2_000, listed // max(1, len(columns))) if listed > 2_000 else listed
    for i, c in enumerate(columns):
        fact = facts[f"v{i}"]
        result[c] = (int(fact["n"]), {})
        if not fact["n"]:
            continue
        wanted = tuple(sorted(set(ranks(int(fact["n"])))))
        whole = Bracket(float(fact["low"]), float(fact["high"]), wanted)
        brackets, expected = [whole], int(fact["n"])
        if expected > share and around:
            mark = dict(zip(around, fact["marks"]))
            brackets = _merged([
                Bracket(
                    whole.low if p - slack <= 0 else mark[min(1.0, max(0.0, p - slack))],
                    whole.high if p + slack >= 1 else mark[min(1.0, max(0.0, p + slack))],
                    _neighbours(p * (expected - 1)),
                ) for p in probs
            ])
            expected = expected if len(brackets) == 1 else int(2 * slack * len(probs) * expected)
        searches[i] = Search(whole, brackets, expected)
    while searches:
        far = {i: s for i, s in searches.items() if s.expected > share and any(b.low < b.high for b in s.brackets)}
        if far:
            _narrow(numbers, far, cells)
            continue
        _list(numbers, searches)
        for i, s in searches.items():
            result[columns[i]][1].update(s.found)
        # a rank outside its bracket means the sketch was worse than promised: search the whole range
        lost = {i: tuple(r for r in s.whole.ranks if r not in s.found) for i, s in searches.items()}
        searches = {
            i: Search(Bracket(s.whole.low, s.whole.high, lost[i]), [Bracket(s.whole.low, s.whole.high, lost[i])], result[columns[i]][0])
            for i, s in searches.items() if lost[i]
        }
    return result


@dataclass
class Search:
    """Where the wanted ranks of one column still have to be looked for."""

    whole: Bracket
    brackets: list[Bracket]
    expected: int  # rows in the brackets
    found: dict[int, float] = field(default_factory=dict)


def _merged(brackets: list[Bracket]) -> list[Bracket]:
    """Overlapping brackets as one, sorted."""
    joined: list[Bracket] = []
    for b in sorted(brackets, key=lambda b: (b.low, b.high)):
        if joined and b.low <= joined[-1].high:
            last = joined.pop()
            b = Bracket(last.low, max(last.high, b.high), (*last.ranks, *b.ranks))
        joined.append(Bracket(b.low, b.high, tuple(sorted(set(b.ranks)))))
    return joined


def _located(numbers: DataFrame, searches: dict[int, Search], cells: dict[int, int] | None = None) -> DataFrame:
    """The known values of the searched columns, each with its column, the number of brackets that start at or below
    it, whether it is in the last one, and its cell there."""
    parts = []
    for i, s in searches.items():
        v, lows = F.col(f"v{i}"), [b.low for b in s.brackets]
        at = range_bin(v, lows)
        high = F.get(lit_array([b.high for b in s.brackets]), at - 1)
        inside = F.coalesce(v <= high, F.lit(False))
        part = [F.lit(i).alias("column"), at.alias("at"), inside.alias("inside"), v.alias("v")]
        if cells is not None:
            count = cells[i]
            width = lit_array([max(b.high / count - b.low / count, 5e-324) for b in s.brackets])
            cell = F.least(F.floor((v - F.get(lit_array(lows), at - 1)) / F.get(width, at - 1)), F.lit(count - 1))
            part.append(F.when(inside, cell).alias("cell"))
        parts.append(F.struct(*part))
    return numbers.select(F.inline(F.array(*parts))).where(F.col("v").isNotNull())


def _list(numbers: DataFrame, searches: dict[int, Search]) -> None:
    """Find the value at each wanted rank from the listed values of the brackets."""
    counted = _located(numbers, searches).groupBy("column", "at", F.when(F.col("inside"), F.col("v")).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).toPandas()
    for column, own in counted.groupby("column"):
        s, before = searches[int(column)], 0
        for at, here in own.groupby("at"):
            if at > 0:
                inside = here[here["value"].notna()].sort_values("value")
                ends, values = before + inside["n"].cumsum().to_numpy(), inside["value"].to_numpy()
                for rank in s.brackets[at - 1].ranks:
                    spot = int(np.searchsorted(ends, rank, side="right"))
                    if before <= rank and spot < len(ends):
                        s.found[rank] = float(values[spot])
            before += int(here["n"].sum())


def _narrow(numbers: DataFrame, searches: dict[int, Search], cells: int) -> None:
    """Cut brackets into equal cells; of each only the cells that hold a wanted rank remain."""
    counts = {i: max(64, cells // len(s.brackets)) for i, s in searches.items()}
    rows = _located(numbers, searches, counts).groupBy("column", "at", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    ).collect()
    for i, s in searches.items():
        kept: list[Bracket] = []
        before, inside = 0, 0
        # cells in ascending order of their values; rows between two brackets come after the lower one
        for at, cell_at, n, low_value, high_value in sorted(
            (r["at"], math.inf if r["cell"] is None else r["cell"], r["n"], r["low"], r["high"]) for r in rows if r["column"] == i
        ):
            if at > 0 and cell_at < math.inf:
                ranks = s.brackets[at - 1].ranks
                wanted = ranks[bisect_left(ranks, before):bisect_left(ranks, before + n)]
                if wanted:
                    kept.append(Bracket(float(low_value), float(high_value), wanted))
                    inside += n if low_value < high_value else 1
            before += n
        s.brackets, s.expected = (kept, inside) if kept else ([s.whole], before)


def range_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value: a halving search over a literal array."""
    n = len(edges)
    if n == 0:
        return F.lit(0)
    table = lit_array(edges)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when((at + step <= n) & (F.get(table, at + step - 1) <= value), step).otherwise(0),
    )


def ranged(df: DataFrame, column: str, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Rows in ascending ranges of about ``rows_per_range``, stored, with the number of their range as ``_range``."""
    ranges = max(1, -(-df.count() // rows_per_range))
    return stored(df.repartitionByRange(ranges, column).withColumn("_range", F.spark_partition_id()), "ranges")


def running_totals(per_value: DataFrame, value: str, sums: Sequence[str], rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Running sums of ``sums`` by ascending ``value``, and the next value, for a table with one row per value.

    Values are dealt into as many ranges as their number asks for. A window runs inside each range; the totals of
    earlier ranges come from a table with one row per range.
    """
    dealt = ranged(per_value.select(value, *sums), value, rows_per_range)
    per_range = dealt.groupBy("_range").agg(F.min(value).alias("_first"), *[F.sum(s).alias(f"_all_{s}") for s in sums])
    by_range = Window.orderBy("_range")
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        "_range",
        F.lead("_first").over(by_range).alias("_following"),
        *[F.coalesce(F.sum(f"_all_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
    )
    inside = Window.partitionBy("_range").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ran = dealt.select(
        "_range", value, *sums,
        F.lead(value).over(inside).alias("_next_inside"),
        *[F.sum(s).over(upto).alias(f"_run_{s}") for s in sums],
    )
    return ran.join(F.broadcast(offsets), "_range").select(
        value, *sums,
        F.coalesce("_next_inside", "_following").alias("next_value"),
        *[(F.col(f"_run_{s}") + F.col(f"_before_{s}")).alias(f"running_{s}") for s in sums],
    )
