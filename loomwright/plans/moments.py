"""Counts, means and covariances of many columns, globally or per group.

Everything linear in this package (regression, component analysis, response search) needs only
these, so the rows are read once and no group is ever gathered in one place.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.plans.columns import apart, filled, q
from loomwright.session import stored

MAX_SQL_PAIRS = 150
# cells of a covariance that one pass adds up
TILE_CELLS = 1 << 22
# rows of a group that one task adds up
SLICE_ROWS = 500_000
# bytes of the matrices that a task holds for groups added up where their rows are read
HELD_BYTES = 1 << 24
# partial sums of a group are put together in so many tasks first
MERGE_WAYS = 32
# rows that are added up at once, few enough to stay in a core's cache
BLOCK_ROWS = 1024


@dataclass(frozen=True)
class Moments:
    """n, mean vector and population covariance matrix of one group of rows."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def pick(self, names: Sequence[str]) -> Moments:
        at = [self.names.index(c) for c in names]
        return Moments(tuple(names), self.n, self.mean[at], self.cov[np.ix_(at, at)])


class Sums:
    """Count, means and products of deviations of some rows; blocks of rows and other sums are added without a common shift."""

    def __init__(self, width: int):
        self.n, self.mean, self.products = 0.0, np.zeros(width), np.zeros((width, width))

    def add(self, block: np.ndarray) -> None:
        for low in range(0, len(block), BLOCK_ROWS):
            some = block[low: low + BLOCK_ROWS]
            mean = some.mean(0)
            some = some - mean
            self.merge(len(some), mean, some.T @ some)

    def merge(self, n: float, mean: np.ndarray, products: np.ndarray) -> None:
        total, step = self.n + n, mean - self.mean
        self.products += products
        if self.n:
            self.products += np.outer(step, step) * (self.n * n / total)
            self.mean = self.mean + step * (n / total)
        else:
            self.mean = mean
        self.n = total

    def record(self, first: dict[str, pa.Array]) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel())) for v in (self.mean, self.products)]
        return pa.RecordBatch.from_arrays([*first.values(), pa.array([self.n]), *lists], names=[*first, "n", "mean", "products"])


def vector_sum(df: DataFrame, column: str, keys: Sequence[str] = (), slices: int = 64) -> DataFrame:
    """Element-wise sum of an array column, in two steps so that no key has one adding task."""
    keys = list(keys)
    part = F.pmod(F.spark_partition_id(), F.lit(slices)).alias("_part")
    vectors = df.select(*[q(k) for k in keys], part, array_to_vector(q(column)).alias("_v"))
    first = vectors.groupBy(*keys, "_part").agg(Summarizer.sum(F.col("_v")).alias("_v"))
    return first.groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias(column))


def partial_sums(df: DataFrame, array_column: str, width: int, function, size: int) -> np.ndarray:
    """Sum over all rows of ``function(matrix) -> vector``; one partial vector per task leaves Python."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += function(matrix_of(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(total))], names=["acc"])

    parts = df.select(q(array_column)).mapInArrow(partials, "acc array<double>")
    return np.array(vector_sum(parts, "acc").first()["acc"])


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Equally long lists as a matrix; a list of another length is an error, since rows would run into each other."""
    lengths = column.value_lengths()
    if len(column) and pa.compute.any(pa.compute.not_equal(lengths, width)).as_py():
        other = next(n for n in lengths.to_pylist() if n != width)
        raise ValueError(f"a vector has {other} elements in place of {width}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)


def packed(df: DataFrame, columns: Sequence[str], shift: Sequence[float] | None = None) -> Column:
    """Columns as one double array, missing as 0, optionally shifted."""
    shift = shift if shift is not None else [0.0] * len(columns)
    return F.array(*[filled(df, c) - F.lit(float(s)) if s else filled(df, c) for c, s in zip(columns, shift)])


def moments_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: keys, n, mean array<double>, cov array<double> (row-major, population)."""
    columns, keys = list(columns), list(keys)
    if len(columns) * (len(columns) + 1) // 2 <= MAX_SQL_PAIRS:
        return _by_aggregates(df, columns, keys)
    return _by_matrices(df, columns, keys)


def _by_aggregates(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    width = len(columns)
    plain = df.select(*[q(k) for k in keys], *[filled(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    pairs = [
        F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)
    ]
    rows = plain.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(width)], *pairs
    )
    return rows.select(
        *[q(k) for k in keys], "n",
        F.array(*[F.col(f"m{i}") for i in range(width)]).alias("mean"),
        F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(width) for j in range(width)]).alias("cov"),
    )


def _by_matrices(df: DataFrame, columns: list[str], keys: list[str], rows_per_slice: int = SLICE_ROWS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """The largest groups are added up where their rows are read; the rows of all others are dealt by group.

    Groups are added up in place as far as their matrices fit ``held_bytes`` of a task: only groups with more than that share of
    the rows, and with so many that their rows are more than the matrices sent. Each task sends one matrix of each, so what is
    shuffled of them grows with the tasks and not with the rows. Of all other groups the rows are shuffled, not a matrix per group
    and batch: a task reads group after group and adds up one matrix at a time. Those of more than ``rows_per_slice`` rows are cut
    into slices, whose sums are put together; there are at most rows / rows_per_slice of them, which bounds the broadcast list.
    Products are of deviations from the means of their own rows, which keeps them well scaled and needs no pass for a shift.
    """
    width = len(columns)
    if not keys:
        found = array_moments(df.select(packed(df, columns).alias("_x")), "_x", width)
        row = [(found.n, found.mean.tolist(), found.cov.ravel().tolist())]
        return df.sparkSession.createDataFrame(row, "n bigint, mean array<double>, cov array<double>")
    names = [f"k{i}" for i in range(len(keys))]
    own_keys = [q(k).alias(name) for k, name in zip(keys, names)]
    plain = df.select(apart(q(keys[0])).alias("k0"), *own_keys[1:], packed(df, columns).alias("_x"))
    counts = stored(df.select(*own_keys).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    rows = counts.agg(F.sum("_n")).first()[0] or 0
    held = held_bytes // (8 * width * (width + 1))
    in_place = F.col("_n") > (max(10 * width, rows // held) if held else rows)  # fewer than ``held`` groups
    large = counts.where(in_place | (F.col("_n") > rows_per_slice)).select(
        *[F.col(k).alias(f"_{k}") for k in names], "_n", F.monotonically_increasing_id().alias("_group"),
        F.when(in_place, 0).otherwise(F.ceil(F.col("_n") / F.lit(rows_per_slice))).cast("int").alias("_slices"))
    large = stored(large, "large-groups")
    done_in_place = large.where("_slices = 0").agg(F.sum("_n")).first()[0] or 0
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names])
    slices = F.coalesce("_slices", F.lit(1))
    marked = plain.join(F.broadcast(large), same, "left").select(*names, "_x", "_group", slices.alias("_slices"))
    kinds = [f.dataType.simpleString() for f in plain.schema.fields[:len(keys)]]
    sums_schema = "n double, mean array<double>, products array<double>"

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record for each group of the task, whose rows come in any order."""
        found: dict[int, Sums] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, groups = matrix_of(batch.column(1), width), batch.column(0).to_numpy()
            for group in np.unique(groups).tolist():
                own, rows_of = found.setdefault(group, Sums(width)), np.flatnonzero(groups == group)
                for low in range(0, len(rows_of), BLOCK_ROWS):
                    own.add(x[rows_of[low: low + BLOCK_ROWS]])
        for group, own in found.items():
            yield own.record({"_group": pa.array([group], pa.int64())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, types, slices_now, group_now, own = None, [], 1, None, Sums(width)

        def sent() -> pa.RecordBatch:
            cells = {name: pa.array([v], t) for name, v, t in zip(names, now, types)}
            return own.record(cells | {"_group": pa.array([group_now], pa.int64()), "_slices": pa.array([slices_now], pa.int32())})

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.column(i).type for i in range(len(names))]
            x = matrix_of(batch.column(len(names)), width)
            groups = list(zip(*[batch.column(i).to_pylist() for i in range(len(names))],
                              batch.column(len(names) + 3).to_pylist(), strict=True))
            cuts = [0, *[i for i in range(1, len(groups)) if groups[i] != groups[i - 1]], len(groups)]
            for low, high in zip(cuts, cuts[1:]):
                if now is not None and groups[low] != now + (slice_now,):
                    yield sent()
                    own = Sums(width)
                now, slice_now = groups[low][:-1], groups[low][-1]
                group_now, slices_now = (batch.column(len(names) + k)[low].as_py() for k in (1, 2))
                own.add(x[low:high])
        if now is not None:
            yield sent()

    def joined(table: pa.Table) -> pa.Table:
        own = Sums(width)
        for n, mean, products in zip(*(table.column(c) for c in ("n", "mean", "products")), strict=True):
            own.merge(n.as_py(), mean.values.to_numpy(), products.values.to_numpy().reshape(width, width))
        return pa.Table.from_batches([own.record({"_group": table.column("_group").slice(0, 1).combine_chunks()})])

    def together(parts: DataFrame) -> DataFrame:
        """One row per large group, put together in two steps so that no group has one adding task."""
        way = F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).alias("_way")
        schema = f"_group long, {sums_schema}"
        some = parts.select("_group", way, "n", "mean", "products").groupBy("_group", "_way").applyInArrow(joined, schema)
        own = some.groupBy("_group").applyInArrow(joined, schema)
        return own.join(F.broadcast(large), "_group").select(*[F.col(f"_{k}").alias(k) for k in names], "n", "mean", "products")

    def finished(sums: DataFrame) -> DataFrame:
        return sums.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("n").cast("long").alias("n"), "mean",
                           F.transform("products", lambda v: v / F.col("n")).alias("cov"))

    parts = []
    if done_in_place:
        parts.append(together(marked.where("_slices = 0").select("_group", "_x").mapInArrow(added, f"_group long, {sums_schema}")))
    if done_in_place < rows or not rows:
        rest = marked.where("_slices > 0").select(
            *names, "_x", "_group", "_slices", F.pmod(F.xxhash64(F.spark_partition_id(), "_x"), F.col("_slices")).cast("int").alias("_slice"))
        schema = ", ".join([*(f"{n} {t}" for n, t in zip(names, kinds)), "_group long, _slices int", sums_schema])
        sums = rest.repartition(*names, "_slice").sortWithinPartitions(*names, "_slice").mapInArrow(summed, schema)
        if not large.where("_slices > 0").isEmpty():
            sums = stored(sums, "group-sums")
            parts.append(together(sums.where("_slices > 1")))
            sums = sums.where("_slices = 1")
        parts.append(sums.select(*names, "n", "mean", "products"))
    return finished(reduce(DataFrame.unionByName, parts))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    columns = list(columns)
    if len(columns) * (len(columns) + 1) // 2 > MAX_SQL_PAIRS:
        found = array_moments(df.select(packed(df, columns).alias("_x")), "_x", len(columns))
        return Moments(tuple(columns), found.n, found.mean, found.cov)
    row = moments_table(df, columns).first()
    width = len(columns)
    if not row["n"]:
        raise ValueError("no rows to fit on")
    return Moments(tuple(columns), int(row["n"]), np.array(row["mean"]), np.array(row["cov"]).reshape(width, width))


def array_moments(df: DataFrame, column: str, width: int, tile: int = TILE_CELLS) -> Moments:
    """Moments of an array column of fixed width; rows with NULL are skipped.

    A covariance of more than ``tile`` cells is made in bands of rows, one pass each, so a task's sums keep their size.
    """
    vectors = df.select(q(column).cast("array<double>").alias("_x")).where(F.col("_x").isNotNull())
    first = partial_sums(vectors, "_x", width, lambda x: np.r_[len(x), x.sum(0)], 1 + width)
    n = first[0]
    if not n:
        raise ValueError("no rows to fit on")
    centre, bands, height = first[1:] / n, [], max(1, tile // width)
    for low in range(0, width, height):
        high = min(width, low + height)

        def products(x: np.ndarray, low=low, high=high) -> np.ndarray:
            x = x - centre
            return np.concatenate([x.sum(0), (x[:, low:high].T @ x).ravel()])

        acc = partial_sums(vectors, "_x", width, products, width + (high - low) * width) / n
        delta = acc[:width]
        bands.append(acc[width:].reshape(high - low, width) - np.outer(delta[low:high], delta))
    return Moments(tuple(f"{column}_{i}" for i in range(width)), int(n), centre + delta, np.vstack(bands))
