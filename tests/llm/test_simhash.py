"""SimHash groups against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomwright.llm import simhash as module
from loomwright.llm.simhash import GrayIndex, SimHash, cell_masks, fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, print int, rows int, component long"


def plain_print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k: k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The least position that links reach, for each of some distinct numbers."""
    top = list(range(len(prints)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    values = np.array(prints, np.uint64)
    for k, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ value) <= 2).tolist():
            a, b = root(k), root(j)
            top[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(prints))]


def brute(rows):
    prints = {}
    for key, text in rows:
        prints.setdefault(plain_print(text), []).append(key)
    groups = plain_groups([*prints])
    least = {}
    for group, keys in zip(groups, prints.values(), strict=True):
        for key in keys:
            if key is not None:
                least[group] = min(key, least.get(group, key))
    return sorted([(key, f"{value:016x}", least.get(group)) for (value, keys), group in zip(prints.items(), groups, strict=True) for key in keys], key=str)


def found(df, **how):
    return sorted([tuple(r) for r in SimHash(**how)(df).collect()], key=str)


@pytest.mark.parametrize("cell", [1024, 2])
def test_simhash_is_exact(spark, sf, cell):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert found(docs, cell=cell) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("cell", [1024, 3])
def test_simhash_of_odd_rows(spark, cell):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(500)}" for _ in range(400)]
    near = []
    for k in range(150):  # a dense group of near copies
        words = list(base)
        words[rnd.randrange(400)] = f"new{k}"
        near.append((1000 + k, " ".join(words)))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d"), (4, "a b c d"), (5, "A  B\nC d"), (None, "no id"), (None, None), (6, "one"), (7, "ONE two"),
            (8, "é漢字 ñandú 😀 x"), (9, "x" * 100_000), (10, " ".join(f"v{i % 997}" for i in range(60_000))), (11, " lead and trail "), *near]
    df = spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], SCHEMA)
    assert found(df, cell=cell) == brute(rows)


def test_simhash_of_nothing(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_prints_do_not_depend_on_slices(monkeypatch):
    rnd = random.Random(1)
    texts = [rnd.choice(["", " ", "a", "b\tc"]) + "".join(rnd.choice("aB \n\x0bc é") for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    want = [plain_print(t) for t in texts]
    for block in (1 << 15, 7):
        monkeypatch.setattr(module, "HASHES", block)
        assert fingerprints(pa.array(texts), 3, 42).tolist() == want


@pytest.mark.parametrize("seed", range(5))
def test_index_finds_all_pairs(seed):
    rnd = np.random.default_rng(seed)
    centres = rnd.integers(0, 1 << 63, 5, dtype=np.uint64)
    values = np.unique(centres[rnd.integers(0, 5, 800)] ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (800, 3), dtype=np.uint64), axis=1))
    cells = np.sort(rnd.integers(0, 4, len(values)))
    one, two = GrayIndex(cells, values).pairs(np.arange(len(values)), 2)
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if cells[i] == cells[j] and int(values[i] ^ values[j]).bit_count() <= 2}
    assert want == set(zip(one.tolist(), two.tolist(), strict=True))
    assert len(one) == len(want)


def test_close_numbers_share_a_cell_on_every_level():
    rnd = random.Random(3)
    for level in range(1, module.LEVELS + 1):
        masks = cell_masks(level)
        assert len(masks) == 3 ** level
        for _ in range(200):
            unlike = 1 << rnd.randrange(64) | 1 << rnd.randrange(64)
            assert any(not unlike & mask for mask in masks)
    assert max(64 - mask.bit_count() for mask in masks) < 11
