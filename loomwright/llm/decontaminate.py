"""Benchmark passages in training texts, found by suffix arrays over shards of the texts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import ALNUM, batch_map, mixed, set_aside, text_slices, words

SHARD_BYTES = 1 << 20
BLOCK_WORDS = 1 << 21
GATE_BITS = 20
MARKS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
MARK_SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


@dataclass
class TestWindows:
    """The different windows of a block of benchmark items, each with the items that hold it."""

    starts: np.ndarray  # windows x width word hashes, 0 behind the end of a short one
    lengths: np.ndarray
    bounds: np.ndarray  # of each window in ``items``
    items: np.ndarray  # item ids as strings
    places: np.ndarray  # where the window stands: windows in a row of one item have numbers in a row
    gate: np.ndarray  # which hashes of two leading words (one, for windows of one word) occur

    @property
    def width(self) -> int:
        return self.starts.shape[1]


def _gate_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mixed(first + second * np.uint64(3)) >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def windows_of(items: list[tuple[str, np.ndarray]], width: int) -> TestWindows:
    rows, lengths, names, places, base = [], [], [], [np.zeros(0, int)], 0
    for name, hashes in items:
        size = min(width, len(hashes))
        if not size:
            continue
        found = np.zeros((len(hashes) - size + 1, width), np.uint64)
        found[:, :size] = np.lib.stride_tricks.sliding_window_view(hashes, size)
        rows.append(found)
        lengths.append(np.full(len(found), size))
        names.extend([name] * len(found))
        places.append(base + np.arange(len(found)))
        base += len(found) + 1
    if not rows:
        return TestWindows(np.zeros((0, width), np.uint64), np.zeros(0, int), np.zeros(1, int), np.zeros(0, object), np.zeros(0, int),
                           np.zeros(1 << GATE_BITS, bool))
    every, size = np.concatenate(rows), np.concatenate(lengths)
    starts, place = np.unique(every, axis=0, return_inverse=True)
    place = place.reshape(-1)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(len(starts) + 1))
    held = np.zeros(len(starts), int)
    held[place] = size
    gate = np.zeros(1 << GATE_BITS, bool)
    second = starts[:, 1] if width > 1 else np.zeros(len(starts), np.uint64)
    gate[_gate_of(starts[:, 0], second)] = True
    return TestWindows(starts, held, bounds, np.array(names, object)[order], np.concatenate(places)[order], gate)


def _below(rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: is it smaller than the wanted one, is it equal, in the order of word sequences."""
    unlike = rows != wanted
    at = unlike.argmax(1)
    line = np.arange(len(rows))
    differs = unlike[line, at]
    return differs & (rows[line, at] < wanted[line, at]), ~differs


class Shard:
    """Suffix array over the words of some texts, holding the suffixes that a benchmark window may begin.

    Suffixes are ordered by their leading ``width`` words (words compare by hash); a suffix ends with its text.
    """

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, tests: TestWindows):
        self.tests, width = tests, tests.width
        padded = np.concatenate([hashes, np.zeros(width + 1, np.uint64)])
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(hashes))
        second = np.where(left > 1, padded[1: len(hashes) + 1], np.uint64(0))
        single = tests.lengths.min(initial=width) == 1
        held = tests.gate[_gate_of(hashes, second)]
        if single:
            held |= tests.gate[_gate_of(hashes, np.zeros_like(hashes))]
        places = np.flatnonzero(held)
        depth = np.arange(width)
        rows = padded[places[:, None] + depth]
        rows[depth >= left[places][:, None]] = 0
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, int)
        self.places, self.rows, self.hashes = places[order], rows[order], hashes

    def _search(self, after: bool) -> np.ndarray:
        """Bound of the suffixes that begin with each window, by binary search for all windows together."""
        wanted, lengths = self.tests.starts, self.tests.lengths
        low, high = np.zeros(len(wanted), int), np.full(len(wanted), len(self.rows))
        mask = np.arange(self.tests.width) < lengths[:, None]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            smaller, equal = _below(np.where(mask[open_], self.rows[middle], 0), wanted[open_])
            right = smaller | equal if after else smaller
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        return low

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """(window, word place) of every occurrence."""
        if not len(self.rows) or not len(self.tests.starts):
            return np.zeros(0, int), np.zeros(0, int)
        low, high = self._search(False), self._search(True)
        count = high - low
        window = np.repeat(np.arange(len(low)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return window, self.places[at]


def _found(data: np.ndarray, bounds: np.ndarray, tests: TestWindows):
    """Words per text, then for each occurrence: text, window, first word within the text; and the hit words."""
    hashes, texts = words(data, bounds, ALNUM)
    window, place = Shard(hashes, texts, tests).matches()
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + tests.lengths[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    text = np.searchsorted(texts, place, "right") - 1
    return texts, text, window, place, hit


def _runs(flags: np.ndarray) -> np.ndarray:
    """First and end place of every run of set flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).astype(np.int64)


def passages(found: list[tuple[int, list[int]]], size: int) -> list[tuple[int, int]]:
    """First word and number of words of the longest passages that a text has in common with an item, word for word.

    ``found`` has, in order of the text's words, where windows of ``size`` words begin, and their places in the item. A
    passage goes on where the next window of the text is the next one of the item. Passages inside a longer one are left out.
    """
    ended, open_, before = [], {}, -2
    for first, places in [*found, (-4, [])]:
        next_ = first == before + 1
        now = {k: open_.get(k - 1, first) if next_ else first for k in places}
        done = [begun for k, begun in open_.items() if not next_ or k + 1 not in now]
        if done:
            ended.append((min(done), before + size))
        open_, before = now, first
    out, least = [], None
    for first, end in reversed(ended):  # by their ends
        if least is None or first < least:
            out.append((first, end - first))
            least = first
    return out[::-1]


@dataclass(frozen=True)
class Decontaminate:
    """Find benchmark passages in texts word for word, and remove the texts that hold too much of them.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. A window is ``width``
    consecutive words of a benchmark item; an item with fewer words is one window. Every window is searched by
    binary search in a suffix array of each shard of the texts, so the work follows the text and is even
    whatever passages repeat. The benchmark is read in blocks of about ``block_words`` words, one pass for each.

    NULL and empty texts have no words and are clean; NULL and empty items are no windows; an empty benchmark
    leaves every text clean. Repeated rows and repeated ids each get their own result. Other columns of either
    table play no part, whatever their names.
    """

    width: int = 13
    share: int = 20  # contaminated if share * hit words >= words
    text: str = "text"
    item: str = "item_id"
    block_words: int = BLOCK_WORDS

    def blocks(self, benchmark: DataFrame) -> list[TestWindows]:
        """The windows of the benchmark, block by block."""

        def hashed(batch: pa.RecordBatch) -> dict:
            names, found = batch.column(0).to_pylist(), []
            for _, _, data, bounds in text_slices(batch.column(1)):
                hashes, at = words(data, bounds, ALNUM)
                found += [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            return {"item": pa.array(names, pa.string()), "words": pa.array(found, pa.binary())}

        rows = batch_map(
            benchmark.select(F.col(self.item).cast("string"), F.col(self.text)), "item string, words binary", hashed
        ).where("item is not null")
        total = rows.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
        count = max(1, -(-int(total) // self.block_words))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
        return [
            windows_of([(r[0], np.frombuffer(r[1], np.uint64)) for r in rows.where(F.col("block") == k).select("item", "words").collect()],
                       self.width)
            for k in range(count)
        ]

    def matches(self, docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
        """Verbatim matches at their full length: key, item, first word in the text, number of words that stand so in the item."""
        kind = docs.schema[key].dataType.simpleString()
        out = None
        for tests in self.blocks(benchmark):
            shared = docs.sparkSession.sparkContext.broadcast(tests)

            def located(batch: pa.RecordBatch, shared=shared) -> dict:
                tests, keys, out = shared.value, batch.column(0), []
                for row, _, data, bounds in text_slices(batch.column(1), SHARD_BYTES):
                    texts, text, window, place, _ = _found(data, bounds, tests)
                    begun: dict[tuple[int, str, int], dict[int, list[int]]] = {}
                    for t, w, p in sorted(zip(text.tolist(), window.tolist(), place.tolist(), strict=True), key=lambda x: x[2]):
                        for k in range(tests.bounds[w], tests.bounds[w + 1]):
                            at = begun.setdefault((t, tests.items[k], int(tests.lengths[w])), {})
                            at.setdefault(p - int(texts[t]), []).append(int(tests.places[k]))
                    for (t, item, width), at in begun.items():
                        out += [(keys[row + t].as_py(), item, first, size) for first, size in passages([*at.items()], width)]
                doc, item, first, size = zip(*out, strict=True) if out else ((), (), (), ())
                return {"doc": pa.array(doc, batch.schema.field(0).type), "item": pa.array(item, pa.string()),
                        "first_word": pa.array(first, pa.int64()), "n_words": pa.array(size, pa.int64())}

            part = batch_map(docs.select(key, self.text), f"doc {kind}, item string, first_word long, n_words long", located)
            out = part if out is None else out.unionByName(part)
        return out.withColumnRenamed("doc", key)

    def __call__(self, docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """The rows of ``docs`` (columns ``keep``, all by default) with the columns of ``MARKS`` added.

        Columns of these names that the table already has are replaced.
        """
        names = [c for c in (docs.columns if keep is None else keep) if c not in MARKS]
        kept = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in names)
        blocks = self.blocks(benchmark)
        # the text travels once: as one of the columns that stay, or beside them
        beside = [] if self.text in names else [F.col(self.text).alias("_text")]
        at = names.index(self.text) if not beside else len(names)
        held = [*names, "_text"] if beside else names
        passed = kept + (", " if kept and beside else "") + ("_text string" if beside else "")
        out = docs.select(*names, *beside, F.lit(b"").alias("_hits"), F.array().cast("array<string>").alias("_items"))
        for k, tests in enumerate(blocks):
            last = k == len(blocks) - 1
            schema = ", ".join(filter(None, [kept, MARK_SCHEMA] if last else [passed, "_hits binary, _items array<string>"]))
            out = batch_map(out, schema, self._marker(docs.sparkSession.sparkContext.broadcast(tests), names, held, at, last))
        return out

    def _marker(self, shared, names: list[str], held: list[str], at: int, last: bool):
        """Add what one block hits; after the last block, sum it up. Columns ``held``, the text at ``at``, come in front."""

        def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
            tests, sizes, hits, items = shared.value, [], [], []
            hits_before, items_before = (batch.column(len(held) + k) for k in (0, 1))
            for row, end, data, bounds in text_slices(batch.column(at), SHARD_BYTES):
                texts, text, window, _, hit = _found(data, bounds, tests)
                sizes += np.diff(texts).tolist()
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(end - row + 1)).tolist()
                for t in range(end - row):
                    before = hits_before[row + t].as_py()
                    if cuts[t] == cuts[t + 1]:
                        hits.append(before)
                        items.append(items_before[row + t].as_py())
                        continue
                    own = hit[texts[t]: texts[t + 1]]
                    for a, b in np.frombuffer(before, np.int64).reshape(-1, 2).tolist():
                        own[a:b] = True
                    hits.append(_runs(own).tobytes())
                    seen = set(items_before[row + t].as_py())
                    for w in np.unique(window[order[cuts[t]: cuts[t + 1]]]).tolist():
                        seen.update(tests.items[tests.bounds[w]: tests.bounds[w + 1]])
                    items.append(sorted(seen))
            made = [batch.column(k) for k in range(len(names) if last else len(held))]
            if not last:
                made += [pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays(made, names=[*held, "_hits", "_items"])
            size = np.array(sizes, np.int64)
            n_hit = np.array([int(np.diff(np.frombuffer(h, np.int64).reshape(-1, 2)).sum()) for h in hits], np.int64)
            digests = [hashlib.sha256(",".join(i).encode()).hexdigest() if i else EMPTY_DIGEST for i in items]
            made += [pa.array(size), pa.array(n_hit), pa.array([len(i) for i in items], pa.int64()), pa.array(digests, pa.string()),
                     pa.array((n_hit > 0) & (self.share * n_hit >= size))]
            return pa.RecordBatch.from_arrays(made, names=[*names, *MARKS])

        return marked

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """The rows of ``docs`` that are not contaminated, with their own columns."""
        held, back = set_aside(docs, (*MARKS, "_text", "_hits", "_items"))
        return self(held, benchmark).where("not contaminated").drop(*MARKS).withColumnsRenamed(back).select(*docs.columns)
