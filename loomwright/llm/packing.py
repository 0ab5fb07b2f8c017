"""Packing documents into sequences of fixed capacity: large items matched, small ones best-fitted into the gaps."""

from __future__ import annotations

import bisect
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.blocks import batch_map, kept
from loomwright.llm.token_counts import LONG_TEXT, Bounded, byte_of_symbol
from loomwright.session import stored

#: separators that the tokenizer drops; other white space stays inside chunks
CHUNK = re.compile(r"[^ \t\n\r]+")
#: a word of plain Latin letters between marks: its borders are borders of the tokenizer's own pieces
MARKS = r"[\x21-\x26\x28-\x40\x5b-\x60\x7b-\x7e]*"
PLAIN = re.compile(f"({MARKS})([a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)({MARKS})")
CACHED = 400_000
CELL_ROWS = 50_000
ID_BYTES = 4


class ChunkEncoder:
    """Token ids of texts by a tokenizer that lower-cases and drops white space: equal chunks are encoded once.

    Plain lower-case words go straight to the merges, all else through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.opening = {s[:2] for s in self.specials}
        self.symbols = {byte: symbol for symbol, byte in byte_of_symbol().items()}
        self.other = Bounded(lambda c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes(), CACHED // 4)
        self.chunk = Bounded(self._chunk, CACHED)

    def _word(self, word: str) -> bytes:
        shown = "".join(map(self.symbols.__getitem__, word.lower().encode("utf-8")))
        return np.array([t.id for t in self.merges.tokenize(shown)], "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if plain is None or any(s in chunk for s in self.specials):
            return self.other[chunk]
        before, word, after = plain.groups()
        return (self.other[before] if before else b"") + self._word(word) + (self.other[after] if after else b"")

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not any(o in text for o in self.opening):  # special tokens keep their case
            text = text.encode("utf-8").lower().decode("utf-8")
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.chunk.__getitem__, CHUNK.findall(text)))
        return b"".join(self.chunk[m.group()] for m in CHUNK.finditer(text))


def encoder_of(path: str) -> ChunkEncoder:
    return kept(f"ids {path}", lambda: ChunkEncoder(path))


class Bins:
    """Sequences that hold the same lengths, as one entry with a count."""

    def __init__(self, count: int, gap: int, items: tuple[tuple[int, int], ...]):
        self.count, self.gap, self.items = count, gap, items  # items: (length, how many of it), in their order

    def with_more(self, count: int, length: int, times: int) -> Bins:
        return Bins(count, self.gap - length * times, (*self.items, (length, times)))


def plan_bins(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Pack a histogram of lengths.

    Lengths above a third of the capacity are large: at most two fit a sequence, so the longest takes the longest
    partner that fits, greedily downwards. Smaller ones, longest first, go into the smallest gap that holds them; a
    new sequence is opened only if none does. Equal lengths are handled together, so the work depends on the
    capacity and not on the number of documents.
    """
    left = {length: count for length, count in histogram.items() if count > 0}
    large = sorted(length for length in left if 3 * length > capacity)
    bins: list[Bins] = []
    while large:
        top = large[-1]
        place = bisect.bisect_right(large, capacity - top) - 1
        partner = large[place] if place >= 0 else None
        if partner is None:
            bins.append(Bins(left[top], capacity - top, ((top, 1),)))
            left[top] = 0
        elif partner == top:
            if pairs := left[top] // 2:
                bins.append(Bins(pairs, capacity - 2 * top, ((top, 2),)))
            left[top] -= 2 * pairs
            if left[top]:
                rest = large[-2] if len(large) > 1 else None  # the odd one takes the next length, which fits as well
                if rest is None:
                    bins.append(Bins(1, capacity - top, ((top, 1),)))
                else:
                    bins.append(Bins(1, capacity - top - rest, ((top, 1), (rest, 1))))
                    left[rest] -= 1
                left[top] = 0
        else:
            pairs = min(left[top], left[partner])
            bins.append(Bins(pairs, capacity - top - partner, ((top, 1), (partner, 1))))
            left[top] -= pairs
            left[partner] -= pairs
        large = [length for length in large if left[length]]
    by_gap: dict[int, list[Bins]] = {}
    for entry in bins:
        by_gap.setdefault(entry.gap, []).append(entry)
    gaps = sorted(by_gap)
    done: list[Bins] = []

    def put(entry: Bins) -> None:
        if not entry.count:
            return
        if entry.gap not in by_gap:
            by_gap[entry.gap] = []
            bisect.insort(gaps, entry.gap)
        by_gap[entry.gap].append(entry)

    for length in sorted((length for length in left if left[length] and 3 * length <= capacity), reverse=True):
        count = left[length]
        while count:
            place = bisect.bisect_left(gaps, length)
            if place == len(gaps):
                each = capacity // length
                fresh = Bins(-(-count // each), capacity, ())
            else:
                gap = gaps[place]
                fresh = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[place]
                each = gap // length
            full = min(fresh.count, count // each)
            put(fresh.with_more(full, length, each))
            count -= full * each
            if full < fresh.count and count:
                put(fresh.with_more(1, length, count))
                full, count = full + 1, 0
            if fresh.items:
                put(Bins(fresh.count - full, fresh.gap, fresh.items))
    for entries in by_gap.values():
        done.extend(entries)
    return done


def slots_of(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, how many in a sequence, offset): where pieces of a length go by rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for entry in bins:
        offset = 0
        for length, times in entry.items:
            first = used.get(length, 0)
            used[length] = first + entry.count * times
            rows.append((length, first, used[length], sequence, times, offset))
            offset += length * times
        sequence += entry.count
    return rows


@dataclass(frozen=True)
class BestFitPacking:
    """Pack token sequences of documents into as few sequences of ``capacity`` tokens as the method finds.

    A document is the ids of its whole text and then the id ``end``; only longer ones are cut, into pieces of exactly
    the capacity, the last piece may be shorter. Which lengths share a sequence is decided on the histogram of
    lengths (at most ``capacity`` numbers); the pieces then take their places by rank among the pieces of the same
    length, counted in cells of about ``cell_rows`` rows, so no length is gathered in one task.

    NULL and empty texts are documents of the one id ``end``. Repeated rows are packed one by one. Columns other than
    ``text`` and ``key`` play no part. An empty table packs into no sequence.
    """

    path: str
    capacity: int = 4096
    end: int = 1
    text: str = "text"
    key: str = "doc_id"
    cell_rows: int = CELL_ROWS

    def pieces(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        """key, piece, start, length, ids_crc32 of every piece, and its ids if asked."""
        path, closing, step = self.path, np.array([self.end], "<u4").tobytes(), self.capacity * ID_BYTES

        def cut(batch: pa.RecordBatch) -> dict:
            encoder, rows, found = encoder_of(path), [], []
            for row, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + closing
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at: at + step]
                    rows.append((row, piece, at // ID_BYTES, len(part) // ID_BYTES, zlib.crc32(part)))
                    if with_ids:
                        found.append(np.frombuffer(part, "<u4"))
            row, piece, start, length, crc = zip(*rows, strict=True)
            made = {"key": batch.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            return made | ({"ids": pa.array(found, pa.list_(pa.int32()))} if with_ids else {})

        kind = docs.schema[self.key].dataType.simpleString()
        out = batch_map(docs.select(self.key, self.text),
                        f"key {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""), cut)
        return out.withColumnRenamed("key", self.key)

    def __call__(self, docs: DataFrame, with_ids: bool = False) -> DataFrame:
        """The pieces with sequence_id and offset."""
        spark = docs.sparkSession
        pieces = stored(self.pieces(docs, with_ids), "pieces")
        counts = {length: count for length, count in pieces.groupBy("length").count().collect()}
        cells = max(1, -(-sum(counts.values()) // self.cell_rows))
        slots = spark.createDataFrame(
            slots_of(plan_bins(counts, self.capacity)),
            T.StructType([T.StructField(n, T.LongType()) for n in ("length", "_first", "_end", "_sequence", "_times", "_offset")]))
        # equal rows may swap places: they are the same pieces
        order = [c for c in pieces.columns if c != "ids"]
        dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64(self.key, "piece", "ids_crc32"), F.lit(cells)))
        within = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*order)) - 1)
        before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (dealt.groupBy("length", "_cell").agg(F.count("*").alias("_count"))
                   .select("length", "_cell", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before")))
        ranked = within.join(offsets, ["length", "_cell"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
        slot = F.broadcast(slots)  # rows bounded by the capacity: see plan_bins
        placed = ranked.join(slot, (ranked["length"] == slot["length"]) & (ranked["_rank"] >= slot["_first"]) & (ranked["_rank"] < slot["_end"]))
        at = F.col("_rank") - F.col("_first")
        return placed.select(
            *(pieces[c] if c == "length" else F.col(c) for c in order),
            (F.col("_sequence") + F.floor(at / F.col("_times"))).alias("sequence_id"),
            (F.col("_offset") + at % F.col("_times") * pieces["length"]).alias("offset"),
            *([F.col("ids")] if with_ids else []))
