"""Language of texts by prediction by partial matching: the language whose byte model codes the text shortest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import batch_map, small_batches, text_slices
from loomwright.llm.learning import bounded_sample, fold, held_out

ORDER = 3  # bytes of context
#: bytes as the models see them: letters ASCII lower-cased, digits alike, other ASCII as a blank
SEEN = np.arange(256, dtype=np.uint8)
SEEN[:128] = 0x20
SEEN[48:58] = 0x30
SEEN[65:91] = SEEN[97:123] = np.arange(97, 123)
BLANK = 0x20


def grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number; a text begins after blanks."""
    size = np.diff(bounds)
    out = np.full(len(data) + ORDER * len(size), BLANK, np.uint32)
    places = np.arange(len(data)) + ORDER * (np.repeat(np.arange(len(size)), size) + 1)
    out[places] = SEEN[data]
    codes = out[ORDER:].copy()
    for back in range(1, ORDER + 1):
        codes |= out[ORDER - back: len(out) - back] << np.uint32(8 * back)
    return codes[places - ORDER]


class Rows:
    """Finds the row of a code: a hash table whose colliding codes go to a further table, and so on."""

    def __init__(self, codes: np.ndarray):
        self.tables = []
        rows, salt = np.arange(len(codes)), 0
        codes = codes.astype(np.uint64)
        while len(rows):
            bits = max(10, int(8 * len(rows)).bit_length())
            slot = self._slot(codes[rows], salt, bits)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[first]] = rows[first]
            self.tables.append((salt, bits, table))
            rows, salt = np.delete(rows, first), salt + 1
        self.codes = codes

    @staticmethod
    def _slot(codes: np.ndarray, salt: int, bits: int) -> np.ndarray:
        return ((codes + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, -1 for unknown ones."""
        out = np.full(len(codes), -1, np.int32)
        codes, open_ = codes.astype(np.uint64), np.arange(len(codes))
        for salt, bits, table in self.tables:
            row = table[self._slot(codes[open_], salt, bits)]
            right = (row >= 0) & (self.codes[row] == codes[open_])
            out[open_[right]] = row[right]
            open_ = open_[~right]
            if not len(open_):
                break
        return out


class ContextTrees:
    """Frozen statistics of byte contexts of up to three bytes, one tree per language, with code lengths in bits.

    A byte seen c times after a context that was seen t times with d different bytes costs -log2(c / (t + d)); an
    unseen one costs the escape -log2(d / (t + d)) and then what it costs after the next shorter context, where
    unseen contexts cost nothing; the last resort is 8 bits.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counts)
        size = len(self.names)
        cost, escape, index = np.full((1, size), 8.0), None, None
        self.levels = []  # order by order: rows of the grams, their costs, escape cost of the grams as contexts
        for order in range(ORDER + 1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            codes = np.unique(np.concatenate([*(c & mask for c, _ in counts.values()), np.zeros(0, np.uint32)]))
            shorter = codes & np.uint32((1 << (8 * order)) - 1) if order else np.zeros(len(codes), np.uint32)
            base = cost[index(shorter)] if order else np.repeat(cost, len(codes), 0)
            made = np.empty((len(codes), size))
            contexts = codes >> np.uint32(8)
            heads, head = np.unique(contexts, return_inverse=True)
            out = np.zeros((len(heads), size))
            for k, name in enumerate(self.names):
                grams_, times = counts[name]
                count = np.bincount(np.searchsorted(codes, grams_ & mask), times, len(codes))
                total, kinds = np.bincount(head, count, len(heads)), np.bincount(head, count > 0, len(heads))
                seen = total > 0
                out[seen, k] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                with np.errstate(divide="ignore"):
                    own = -np.log2(count / np.maximum(total + kinds, 1)[head])
                made[:, k] = np.where(count > 0, own, out[head, k] + base[:, k])
            if order:  # the contexts of this order are grams of the order below
                held = np.zeros((len(cost), size))
                rows = index(heads)
                held[rows[rows >= 0]] = out[rows >= 0]
                self.levels[-1][2] = held.astype(np.float32)
            else:
                escape = out if len(out) else np.zeros((1, size))
                self.start = (8.0 + escape[0]).astype(np.float32)
            cost, index = made, Rows(codes)
            self.levels.append([index, made.astype(np.float32), None])

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language."""
        out = np.zeros((len(codes), len(self.names)), np.float32)
        open_ = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            index, cost, _ = self.levels[order]
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            row = index(codes[open_] & mask)
            seen = row >= 0
            out[open_[seen]] += cost[row[seen]]
            open_ = open_[~seen]
            if not len(open_):
                return out
            if order:
                below, _, escape = self.levels[order - 1]
                context = below((codes[open_] >> np.uint32(8)) & (mask >> np.uint32(8)))
                out[open_[context >= 0]] += escape[context[context >= 0]]
        out[open_] += self.start
        return out


@dataclass(frozen=True)
class Languages:
    """Predict the language of whole texts.

    Per language a tree of byte contexts of up to three bytes is counted on a bounded sample, about ``per_language``
    texts that are not held out. A text goes to the language with the least code length over all its bytes; ``score``
    is that language's share of the likelihoods. Of equal ones the first name wins.

    NULL texts and texts without a letter are ``und`` with score 0; so is every text if no language could be learned.
    Rows without language or key teach nothing. Repeated rows are predicted one by one, other columns stay as they are.
    """

    parts: int = 5
    part: int = 0
    per_language: int = 3000
    text: str = "text"
    lang: str = "lang"
    key: str = "doc_id"

    def fit(self, docs: DataFrame) -> ContextTrees:
        rows = docs.select(F.col(self.key).alias("_key"), F.col(self.lang).alias("_lang"), F.col(self.text).alias("_text"))
        known = rows.where("_lang is not null and _text is not null").where(fold("_key", self.parts) != self.part)
        chosen = bounded_sample(known, "_lang", "_key", self.per_language).select("_lang", "_text")

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = np.array(batch.column(0).to_pylist(), object)
                out: tuple[list, list, list] = ([], [], [])
                for row, end, data, bounds in text_slices(batch.column(1)):
                    codes, size = grams(data, bounds), np.diff(bounds)
                    for name in sorted(set(names[row:end])):
                        found, times = np.unique(codes[np.repeat(names[row:end] == name, size)], return_counts=True)
                        out[0].extend([name] * len(found))
                        out[1].append(found.astype(np.int64))
                        out[2].append(times.astype(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array(out[0], pa.string()), "code": pa.array(np.concatenate([*out[1], np.zeros(0, np.int64)])),
                    "times": pa.array(np.concatenate([*out[2], np.zeros(0, np.int64)]))})

        sums = (small_batches(chosen).mapInArrow(counted, "lang string, code long, times long")
                .groupBy("lang", "code").agg(F.sum("times").alias("times"))).toArrow()
        names, codes, times = np.array(sums.column(0).to_pylist(), object), sums.column(1).to_numpy(), sums.column(2).to_numpy()
        return ContextTrees({n: (codes[names == n].astype(np.uint32), times[names == n]) for n in sorted(set(names))})

    def predict(self, docs: DataFrame, trees: ContextTrees, keep: tuple[str, ...] | None = None) -> DataFrame:
        """The rows with ``lang_pred`` and ``score`` added; columns of these names are replaced."""
        names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
        kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
        shared = docs.sparkSession.sparkContext.broadcast(trees)

        def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
            trees, texts = shared.value, batch.column(len(names))
            lang, share = [], []
            for row, end, data, bounds in text_slices(texts, 1 << 18):
                plain = np.add.reduceat(np.append((SEEN[data] >= 97) & (data < 128), False), np.minimum(bounds[:-1], len(data))) > 0
                plain &= np.diff(bounds) > 0
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                length = np.zeros((end - row, len(trees.names)))
                if len(full) and trees.names:
                    length[full] = np.add.reduceat(trees.bits(grams(data, bounds)), bounds[:-1][full], axis=0, dtype=np.float64)
                for t in range(end - row):
                    if not trees.names or not size[t] or not (plain[t] or any(map(str.isalpha, texts[row + t].as_py()))):
                        lang.append("und")
                        share.append(0.0)
                        continue
                    best = int(length[t].argmin())
                    lang.append(trees.names[best])
                    share.append(float(1 / np.exp2(np.maximum(length[t][best] - length[t], -1000)).sum()))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(names))), pa.array(lang, pa.string()), pa.array(share, pa.float64())],
                names=[*names, "lang_pred", "score"])

        return batch_map(docs.select(*names, F.col(self.text).alias("_text")), f"{kept}lang_pred string, score double", predicted)

    def __call__(self, docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """Learn from these texts, then predict all of them; ``held_out`` marks the rows that taught nothing by their key."""
        out = self.predict(docs, self.fit(docs), keep if keep is None or self.key in keep else (*keep, self.key))
        return out.withColumn("held_out", held_out(self.key, self.parts, self.part))
