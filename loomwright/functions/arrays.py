"""Vectors as array columns, lists, and age ranges."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.plans.columns import let


def root_name(names: Sequence[str]) -> str | None:
    """What all names start with, without closing underscores."""
    shared = "".join(
        letters[0] for letters in takewhile(lambda letters: len(set(letters)) == 1, zip(*names))
    ).rstrip("_")
    return shared or None


def norm(vector: Column, order: int = 2) -> Column:
    power = (lambda x: x * x) if order == 2 else F.abs
    total = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + F.coalesce(power(x.cast("double")), F.lit(0.0)))
    return F.sqrt(total) if order == 2 else total


def unit(vector: Column, order: int = 2) -> Column:
    """The vector divided by its norm; NULL when the norm is 0."""
    return let(vector, lambda v: let(norm(v, order), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))))


def mean_of(vectors: Sequence[Column], width: int) -> Column:
    """Element-wise mean; a missing vector counts as zeros."""
    nothing = F.array_repeat(F.lit(0.0), width)
    whole = [F.transform(F.coalesce(v, nothing), lambda x: F.coalesce(x.cast("double"), F.lit(0.0))) for v in vectors]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), whole)
    return F.transform(total, lambda x: x / F.lit(float(len(vectors))))


def windows(vector: Column, width: int, size: int, stride: int, padding: int = 0) -> Column:
    """Slices of ``size`` elements every ``stride`` elements, zeros added on both ends."""
    if padding:
        zeros = F.array_repeat(F.lit(0.0), padding)
        vector = F.concat(zeros, vector.cast("array<double>"), zeros)
    last = width + 2 * padding - size
    if last < 0:
        raise ValueError("the window is longer than the vector")
    starts = F.sequence(F.lit(1), F.lit(last + 1), F.lit(stride))
    return F.transform(starts, lambda at: F.slice(vector, at, size))


def gaussian_window(side: int, sigma: float = 1.0, mu: float = 0.0) -> list[float]:
    """Row-major weights of a round bump on the square [-1, 1] x [-1, 1]."""
    ticks = [0.0] if side == 1 else [-1 + 2 * i / (side - 1) for i in range(side)]
    height = 1 / (2 * math.pi * sigma**2)
    return [height * math.exp(-((math.hypot(x, y) - mu) ** 2) / (2 * sigma**2)) for y in ticks for x in ticks]


def overlap_taps(
    width: int, size: int, stride: int, padding: int, weights: Sequence[float], cells: Sequence[int] | None = None
) -> tuple[int, list[list[tuple[int, float]]]]:
    """Which vector positions, with which weights, add up in each cell of the overlap grid.

    Windows are laid on a square grid of blocks: block (row, col) shows window (row + col) modulo the
    number of windows, shifted by the square root of the stride. ``cells`` names the window position
    shown in each cell of a block (row-major when not given).
    """
    side, step = math.isqrt(size), math.isqrt(stride)
    if side * side != size:
        raise ValueError("the window size must be a square number")
    cells = list(cells) if cells is not None else list(range(size))
    count = (width + 2 * padding - size) // stride + 1
    edge = side + step * (count - 1)
    taps: list[list[tuple[int, float]]] = [[] for _ in range(edge * edge)]
    for block_row in range(count):
        for block_col in range(count):
            start = ((block_row + block_col) % count) * stride - padding
            for r in range(side):
                for c in range(side):
                    position = start + cells[r * side + c]
                    if 0 <= position < width:
                        place = (block_row * step + r) * edge + block_col * step + c
                        taps[place].append((position, float(weights[r * side + c])))
    return edge, taps


def overlap_add(vector: Column, taps: Sequence[Sequence[tuple[int, float]]]) -> Column:
    """Row-wise overlap grid from literal taps: a fixed linear map, so nothing is shuffled."""
    table = F.array(*[
        F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in cell])
        if cell else F.array(F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("w")))
        for cell in taps
    ])
    return F.transform(
        table,
        lambda cell: F.aggregate(
            cell, F.lit(0.0), lambda acc, tap: acc + F.get(vector, tap["p"]).cast("double") * tap["w"]
        ),
    )


def age_bins(bins: int, low: int, high: int) -> list[tuple[int, int]]:
    """First and last whole age of each of ``bins`` equal bins on [low, high]; the last one is closed."""
    edges = [low + (high - low) * k / bins for k in range(bins + 1)]
    firsts = [math.ceil(e) for e in edges]
    return [(firsts[k], firsts[k + 1] - 1 if k < bins - 1 else high) for k in range(bins)]


def age_histogram(
    lows: Column, highs: Column, normalize: bool = True, bins: int = 12, low: int = 1, high: int = 120,
    order: int = 2,
) -> Column:
    """How the whole ages of all ranges fall into the bins; no ranges means every age."""
    scale = bins / (high - low + 1)

    def in_bin(first: int, last: int) -> Column:
        return F.aggregate(
            F.zip_with(lows, highs, lambda a, b: F.greatest(
                F.lit(0), F.least(b, F.lit(last)) - F.greatest(a, F.lit(first)) + 1)),
            F.lit(0.0), lambda acc, x: acc + x.cast("double"),
        ) * F.lit(scale)

    counted = F.array(*[in_bin(a, b) for a, b in age_bins(bins, low, high)])
    empty = (F.coalesce(F.size(lows), F.lit(0)) < 1) | (F.coalesce(F.size(highs), F.lit(0)) < 1)
    hist = F.when(empty, F.array_repeat(F.lit(1.0), bins)).otherwise(counted)
    return unit(hist, order) if normalize else hist
