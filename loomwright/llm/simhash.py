"""Near-duplicate texts by SimHash: a Gray-order hierarchical index over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import batch_map, give_back, small_batches, text_slices
from loomwright.llm.links import components
from loomwright.plans.joins import salted_join
from loomwright.session import stored

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
HASHES = 1 << 15
FAN = 8
QUERIES = 1024
HELD_ROWS = 1 << 14
LEVELS = 5


def spaced_words(data: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of some texts with one space behind each, their starts and ends there, and the texts' bounds
    among the words. No word reaches over the end of a text."""
    if not len(data):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    space = SPACE[data]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    before[begins] = True
    starts = np.flatnonzero(~space & before)
    keep = ~space | ~before
    place = np.cumsum(keep) - 1
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    after[begins[begins > 0] - 1] = True
    ends = place[np.flatnonzero(~space & after)] + 1
    return np.where(space, np.uint8(32), LOWER[data])[keep].tobytes(), place[starts], ends, np.searchsorted(starts, bounds)


def fingerprints(column: pa.Array, width: int, seed: int) -> np.ndarray:
    """The fingerprint of every text: bit b is 1 if it is 1 in the hashes of over half of the shingles."""
    out = []
    for _, _, data, bounds in text_slices(column):
        words, starts, ends, at = spaced_words(data, bounds)
        counts = np.diff(at)
        # the shingles of a text begin at its words but the last ones; a short text has one, its whole sequence
        sizes = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + at[owner]
        last = np.minimum(first + width, at[owner + 1]) - 1
        ones = np.zeros((len(sizes), 64), np.int64)
        for k in range(0, len(owner), HASHES):
            some = owner[k: k + HASHES]
            spans = zip(starts[first[k: k + HASHES]].tolist(), ends[last[k: k + HASHES]].tolist(), strict=True)
            hashes = np.array([xxhash.xxh64_intdigest(words[a:b], seed) for a, b in spans], np.uint64)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            ones[some[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        majority = 2 * ones > sizes[:, None]
        out.append(np.packbits(majority, axis=1, bitorder="little").view(np.uint64).reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def cell_masks(level: int) -> list[int]:
    """The masks of a level, by number: each mask of the level before, with one of three parts of the bits it leaves.

    Numbers that differ in at most two bits are equal under at least one mask of every level, since at least one of three
    parts has no difference. Mask ``m`` of a level has the children ``3 * m``, ``3 * m + 1`` and ``3 * m + 2`` in the next.
    """
    masks = [0]
    for _ in range(level):
        grown = []
        for mask in masks:
            free = [b for b in range(64) if not mask >> b & 1]
            cuts = [len(free) * k // 3 for k in range(4)]
            grown += [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
        masks = grown
    return masks


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def gray_rank(name: str):
    """The place of a number in Gray order, as an unsigned number: each bit is the parity of the bits from it on."""
    rank = F.col(name)
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    return rank


class GrayIndex:
    """Many small indexes side by side, one per cell, as trees of masked bit patterns.

    The members of a cell stand in Gray order, in which neighbours differ in few bits. Runs of ``FAN`` neighbours form a
    node that holds the bits all of them share; a member keeps only the rest. Runs of nodes form the next level likewise.
    """

    def __init__(self, cells: np.ndarray, values: np.ndarray):
        self.values = values
        place = np.arange(len(values))
        self.levels = []  # from members up: (pattern, mask of the bits not held above, first child, end child, last member)
        pattern, mask = values, np.full(len(values), ~np.uint64(0))
        first, end, last, own = place, place + 1, place, cells
        while True:
            top = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[top, len(own)])
            if size.max() == 1:
                self.levels.append((pattern, mask, first, end, last))
                break
            within = np.arange(len(own)) - np.repeat(top, size)
            heads = np.flatnonzero(within % FAN == 0)
            group = np.cumsum(within % FAN == 0) - 1
            unlike = np.bitwise_or.reduceat(pattern ^ pattern[heads][group], heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~unlike
            self.levels.append((pattern, mask & ~shared[group], first, end, last))
            end = np.r_[heads[1:], len(own)]
            pattern, mask, first, last, own = pattern[heads], shared, heads, last[end - 1], own[heads]
        self.root = np.repeat(np.arange(len(own)), np.diff(np.r_[np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]), len(cells)]))

    def pairs(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, later member of its cell) with at most ``most`` differing bits.

        From the root down, the differences in the shared bits of each node are added up; a node beyond ``most`` is left
        with all its members.
        """
        who, node = queries, self.root[queries]
        far = np.zeros(len(queries), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask, first, end, last = self.levels[depth]
            far = far + np.bitwise_count((self.values[who] ^ pattern[node]) & mask[node])
            near = (far <= most) & (last[node] > who)
            who, node, far = who[near], node[near], far[near]
            if depth:
                count = end[node] - first[node]
                below = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[node], count)
                who, far, node = np.repeat(who, count), np.repeat(far, count), below
        return who, node

    def joined(self, most: int) -> np.ndarray:
        """For every member the first member of its cell that links reach from it."""
        label = np.arange(len(self.values))
        for k in range(0, len(self.values), QUERIES):
            one, two = self.pairs(np.arange(k, min(k + QUERIES, len(self.values))), most)
            while True:
                a, b = label[one], label[two]
                if (a == b).all():
                    break
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        return label


@dataclass(frozen=True)
class SimHash:
    """Groups of texts whose 64-bit SimHash fingerprints differ in at most ``most`` (at most 2) bits.

    Words are runs of anything but ASCII white space, A-Z lower-cased; the shingles of ``width`` words of the whole text,
    repeats included, are joined by spaces and hashed by XXH64. A text of fewer words has one shingle, its whole sequence.
    A component is all that links reach; every link between different fingerprints is honoured, though pairs are not listed.

    1. Rows with the same fingerprint are one class.
    2. Each class goes to three cells, by a third of its bits each: linked fingerprints are equal in one of them. A cell
       of more than ``cell`` classes is divided by thirds of the bits it leaves, and so on, so that no task holds a large
       one; after ``LEVELS`` divisions fewer than 10 bits are left. A cell is the top node of an index: the bits that all its
       members share.
    3. In a cell, members are sorted by Gray rank and indexed by the masked patterns they share (``GrayIndex``). Each
       member searches from the root, adding up differences and leaving whole groups beyond the limit. A cell hands on
       one link per member at most, to the first member that its links reach.
    4. Links of all cells are joined to components.

    NULL and empty texts, and those without words, have fingerprint zero and are linked like any other. Repeated rows are
    kept. NULL ids are never a component's id unless it has no other. Other columns play no part, whatever their names.
    """

    width: int = 3
    most: int = 2
    cell: int = 1024
    seed: int = 42
    text: str = "text"
    key: str = "doc_id"

    def __post_init__(self):
        if not 0 <= self.most <= 2:
            raise ValueError("three parts find up to 2 differing bits")

    def __call__(self, docs: DataFrame) -> DataFrame:
        """key, fingerprint (16 hexadecimal digits) and component_id of every row."""
        rows = stored(self.prints(docs), "prints")
        classes = stored(rows.groupBy("print").agg(F.min("key").alias("least"), F.count("*").alias("rows")), "print-classes")
        # lists of hot keys have 1,000 entries at most, whatever the size
        share = max(1000, rows.count() // 1000)
        joined = components(self.links(classes.select("print"))).select(F.col("node").alias("print"), "component")
        named = classes.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
        first = named.groupBy("component").agg(F.min("least").alias("component_id"))
        found = salted_join(named.select("print", "component", "rows"), first, ["component"], rows_per_task=share)
        found = stored(found.select("print", "component_id", "rows"), "print-components")
        counts = found.select("print", F.col("rows").alias("_n"))
        out = salted_join(rows, found.select("print", "component_id"), ["print"], counts=counts, rows_per_task=share)
        return out.select(F.col("key").alias(self.key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

    def prints(self, docs: DataFrame) -> DataFrame:
        """key and print (the fingerprint as a long) of every row."""
        width, seed = self.width, self.seed
        kind = docs.schema[self.key].dataType.simpleString()

        def made(batch: pa.RecordBatch) -> dict:
            return {"key": batch.column(0), "print": pa.array(fingerprints(batch.column(1), width, seed).view(np.int64), pa.int64())}

        return batch_map(docs.select(F.col(self.key).alias("key"), F.col(self.text).alias("words")), f"key {kind}, print long", made)

    def links(self, classes: DataFrame) -> DataFrame:
        """Links (a, b) that join all fingerprints in reach of each other, from a table of distinct ones."""
        rows = classes.select("print", F.lit(0).alias("path"), F.lit(0).cast("long").alias("bits"))
        found = None
        for level in range(1, LEVELS + 1):
            rows = self._divided(rows, level)
            hot = None
            if level < LEVELS:
                counted = rows.groupBy("path", "bits").agg(F.count("*").alias("members")).where(F.col("members") > self.cell)
                hot = stored(counted.select("path", "bits"), "large-cells")
                if hot.isEmpty():
                    hot = None
            if hot is None:
                linked = self._linked(rows)
                return linked if found is None else found.unionByName(linked)
            slices = 16
            marked = stored(rows.withColumn("slice", F.pmod(F.xxhash64("print"), F.lit(slices)).cast("int")).join(
                hot.select("path", "bits", F.explode(F.expr(f"sequence(0, {slices - 1})")).alias("slice"), F.lit(True).alias("large")),
                ["path", "bits", "slice"], "left"), "cells")
            linked = self._linked(marked.where("large is null").select("print", "path", "bits"))
            found = linked if found is None else found.unionByName(linked)
            rows = marked.where("large").select("print", "path", "bits")
        return found

    def _divided(self, rows: DataFrame, level: int) -> DataFrame:
        """Every row in three cells, each with a third of the bits that its cell has left."""
        masks = F.array(*[F.lit(signed(m)) for m in cell_masks(level)])
        return (rows.select("print", F.explode(F.array(*[3 * F.col("path") + k for k in range(3)])).alias("path"))
                .select("print", "path", F.col("print").bitwiseAND(F.get(masks, F.col("path"))).alias("bits")))

    def _linked(self, rows: DataFrame) -> DataFrame:
        most = self.most

        def links_of(paths: np.ndarray, bits: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            new = np.r_[True, (paths[1:] != paths[:-1]) | (bits[1:] != bits[:-1])]
            cells = np.cumsum(new) - 1
            many = np.bincount(cells)[cells] > 1
            cells, values = cells[many], values[many]
            if not len(values):
                return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            label = GrayIndex(cells, values).joined(most)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_pydict({"a": pa.array(values[moved].view(np.int64)), "b": pa.array(values[label[moved]].view(np.int64))})

        def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64) for _ in range(3)]
            for batch in batches:
                held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
                paths, bits, values = held
                if len(paths) < HELD_ROWS:
                    continue
                ends = np.flatnonzero((paths[1:] != paths[:-1]) | (bits[1:] != bits[:-1])) + 1
                if len(ends):  # the last cell may go on in the next batch
                    yield links_of(paths[: ends[-1]], bits[: ends[-1]], values[: ends[-1]].view(np.uint64))
                    held = [h[ends[-1]:] for h in held]
            if len(held[0]):
                yield links_of(held[0], held[1], held[2].view(np.uint64))
            give_back()

        # Gray ranks are unsigned: turning the first bit lets signed numbers sort like them
        order = gray_rank("print").bitwiseXOR(F.lit(-(1 << 63)))
        dealt = rows.select(F.col("path").cast("long").alias("path"), "bits", "print").repartition("path", "bits")
        return small_batches(dealt.sortWithinPartitions("path", "bits", order)).mapInArrow(indexed, "a long, b long")
