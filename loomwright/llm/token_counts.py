"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.blocks import batch_map, kept

#: fixed values: how the vocabulary's library splits text before the merges, and its white space
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CACHED = 300_000
LONG_TEXT = 1 << 20
LONGEST_KEY = 64
NEVER = 1 << 60
LOW_BITS = (1 << 32) - 1


def byte_of_symbol() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Bounded(dict):
    """A cache of bounded size: when full, its entries become the old generation, from which those in use return.

    Texts of more than ``LONGEST_KEY`` characters are not kept, which bounds its bytes.
    """

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if not isinstance(key, int) and len(key) > LONGEST_KEY:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PrefixCounter:
    """Dynamic programme over prefixes.

    The encoding of a prefix is the encoding of a shorter prefix and one last token; the last token is the one whose
    join with the token before it is left apart by the merges. So each prefix needs only its last token's length,
    found among the vocabulary's tokens that end there, and its count is one more than that of the shorter prefix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol = byte_of_symbol()

        def raw(token: str) -> bytes:
            return bytes(symbol[c] for c in token)

        self.specials = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        named = set(self.specials)
        self.names = [raw(t) for t in spec["model"]["vocab"] if t not in named]
        self.tokens = {t: k for k, t in enumerate(self.names)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in reversed(self.rank)}
        self.edges = Bounded(lambda token: (self._edge(token, 0), self._edge(token, 1)), len(self.tokens) + 1)
        self.longest = max(map(len, self.tokens))
        self.split = regex.compile(PIECE)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.apart = Bounded(self._apart)  # by the two tokens' numbers in one
        self.whole = Bounded(lambda token: self._merged(self.names[token]) == [self.names[token]], len(self.names) + 1)
        self.piece = Bounded(lambda piece: self.column(piece.encode("utf-8"))[-1])
        self.chunk = Bounded(self._chunk)

    def _merged(self, data: bytes) -> list[bytes]:
        """The merges done in order, for a few bytes."""
        parts = [data[k: k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            made, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    made.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    made.append(parts[k])
                    k += 1
            parts = made
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a token while it is merged, last one first, with the merge that ends each."""
        parts, ends = [], NEVER
        while True:
            parts.append((token, ends))
            halves = self.halves.get(token)
            if halves is None:
                return parts
            token, ends = halves[side], self.rank[halves]

    def _apart(self, pair: int) -> bool:
        """No merge across the border comes before the merges inside both tokens that would use up its sides.

        A part lasts from the merge that makes it to the one that uses it. Of equal merges the left one is done first.
        """
        rank = self.rank
        right_of_left, left_of_right = self.edges[self.names[pair >> 32]][1], self.edges[self.names[pair & LOW_BITS]][0]
        for a, a_ends in right_of_left:
            for b, b_ends in left_of_right:
                across = rank.get((a, b))
                if across is not None and across < a_ends and across <= b_ends:
                    return False
        return True

    def column(self, data: bytes) -> list[int]:
        """Token count of every byte prefix of one piece, the empty one included."""
        size = len(data)
        count, last, token_of, apart, longest = [0] * (size + 1), [0] * (size + 1), self.tokens.get, self.apart, self.longest
        for end in range(1, size + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = token_of(data[start:end])
                if token is not None and (apart[last[start] << 32 | token] if start else self.whole[token]):
                    count[end], last[end] = count[start] + 1, token
                    break
        return count

    def _plain(self, text: str) -> int:
        return sum(map(self.piece.__getitem__, self.split.findall(text)))

    def _chunk(self, chunk: str) -> int:
        if self.special is None:
            return self._plain(chunk)
        parts = self.special.split(chunk)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def total(self, text: str) -> int:
        """Tokens of a whole text. Chunks (white space, then the rest) never share a token."""
        if len(text) <= LONG_TEXT:
            return sum(map(self.chunk.__getitem__, CHUNK.findall(text)))
        return sum(self.chunk[m.group()] for m in CHUNK.finditer(text))

    def _prefixes(self, chunk: str) -> Iterator[int]:
        """Token count after each character of a chunk without special tokens."""
        body = len(chunk) - len(chunk.lstrip(WHITE_SET))
        if body:
            white = self.column(chunk[:body].encode("utf-8"))
            at = 0
            for c in chunk[:body]:
                at += len(c.encode("utf-8"))
                yield white[at]
        before, place = 0, 0
        for piece in self.split.findall(chunk):
            counts, at = self.column(piece.encode("utf-8")), 0
            for k, c in enumerate(piece):
                at += len(c.encode("utf-8"))
                place += 1
                if place > body:
                    cut = piece[: k + 1]
                    yield before + (self._plain(cut) if piece in CONTRACTIONS and cut != piece else counts[at])
            before += counts[-1]

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of every prefix ``text[:k]``, k from 0: the table that answers truncation and budget questions."""
        out, before, start = [0], 0, 0
        found = [*self.special.finditer(text)] if self.special else []
        for m in [*found, None]:
            section = text[start: m.start() if m else len(text)]
            for chunk in CHUNK.findall(section):
                out.extend(before + n for n in self._prefixes(chunk))
                before = out[-1]
            if m:  # an unfinished special token is plain text and joins what stands before it
                base = out[start]
                for k in range(m.start() + 1, m.end()):
                    out.append(base + sum(map(self._chunk, CHUNK.findall(text[start:k]))))
                before = before + 1
                out.append(before)
                start = m.end()
        return np.array(out, np.int32)


WHITE_SET = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))


def counter_of(path: str) -> PrefixCounter:
    return kept(f"counts {path}", lambda: PrefixCounter(path))


@dataclass(frozen=True)
class TokenCounts:
    """Token counts of whole texts by prefix dynamic programming; the vocabulary file is a parameter.

    Every worker reads the vocabulary from ``path``. Counts of pieces are kept in bounded caches. NULL and empty texts
    have 0 bytes and 0 tokens. Special strings inside texts are one token each. Rows stay as they are, repeated ones
    too; columns of the table that carry a name added here are replaced.
    """

    path: str
    text: str = "text"
    limit: int = 512

    def _added(self, docs: DataFrame, keep: tuple[str, ...] | None, added: str, work) -> DataFrame:
        new = [part.split()[0] for part in added.split(", ")]
        names = [c for c in (docs.columns if keep is None else keep) if c not in new]
        kept_columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
        path = self.path

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = work(counter_of(path), batch.column(len(names)))
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), *made], names=[*names, *new])

        return batch_map(docs.select(*names, F.coalesce(F.col(self.text), F.lit("")).alias("_text")),
                         ", ".join(filter(None, [kept_columns, added])), run)

    def __call__(self, docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """n_bytes, n_tokens and over_limit of every text."""

        def counts(counter: PrefixCounter, texts: pa.Array) -> list[pa.Array]:
            found = np.array([counter.total(t.as_py()) for t in texts], np.int64)
            return [pa.compute.binary_length(texts).cast(pa.int64()), pa.array(found), pa.array(found > self.limit)]

        return self._added(docs, keep, "n_bytes bigint, n_tokens bigint, over_limit boolean", counts)

    def tables(self, docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
        """``prefix_tokens``: token count of every prefix, by number of characters, the empty prefix first."""

        def counts(counter: PrefixCounter, texts: pa.Array) -> list[pa.Array]:
            return [pa.array([counter.prefixes(t.as_py()) for t in texts], pa.list_(pa.int32()))]

        return self._added(docs, keep, "prefix_tokens array<int>", counts)


def tokens_at(table: str, characters: int):
    """From a table of ``TokenCounts.tables``: the token count of the first characters."""
    return F.element_at(table, F.least(F.lit(characters + 1), F.size(table)))


def characters_within(table: str, budget: int):
    """The most characters that a prefix of at most ``budget`` tokens can have."""
    return F.size(table) - 1 - F.coalesce(
        F.array_position(F.transform(F.reverse(F.col(table)), lambda n: (n <= budget).cast("int")), 1) - 1, F.lit(0))
