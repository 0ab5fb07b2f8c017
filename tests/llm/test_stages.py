"""The pipeline's stages on rows that are odd in every way, and what they must not lose or overwrite."""

import pytest

import corpus_pipeline
from loomwright.llm.decontaminate import Decontaminate
from loomwright.llm.licenses import LicenseScan
from loomwright.llm.ngram_join import NgramJoin

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, n_hit string, _own_n_hit string, "
          "key string, _row int, node string, _words string, _gated string, row int, place int, _text string, _key string")


@pytest.fixture(scope="module")
def odd(spark):
    words = " ".join(f"alpha{i}" for i in range(40))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, words), (4, words), (5, words + " extra"), (5, "another text under this id"), (None, "text without id"),
             (6, " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))), (7, "one"), (8, "é漢字 ñandú 😀"), (9, None), (10, "x" * 50_000)]
    rows = [(i, t, None, "s", None if t is None else len(t), "own", 3, "mine", "too", "k", 1, "n", "w", "g", 2, 3, "t", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def plain(df):
    return sorted(map(str, df.select("doc_id", "text").collect()))


@pytest.mark.parametrize("name", [n for n in STAGES if n != "best_fit_packing"])
def test_stage_keeps_clean_rows_and_columns(spark, sf, odd, name):
    out = STAGES[name](spark, odd, sf)
    assert out.columns == odd.columns
    gone = {"ngram_jaccard_join": [(5, odd.where("doc_id = 4").first().text + " extra")]}.get(name, [])
    expected = [r for r in odd.select("doc_id", "text").collect() if tuple(r) not in gone]
    assert plain(out) == sorted(map(str, expected))
    others = [c for c in odd.columns if c not in ("doc_id", "text", "n_chars")]
    assert {tuple(r) for r in out.select(*others).collect()} == {tuple(r) for r in odd.select(*others).collect()}


@pytest.mark.parametrize("name", STAGES)
def test_stage_of_nothing(spark, sf, name):
    out = STAGES[name](spark, spark.createDataFrame([], SCHEMA), sf)
    assert out.count() == 0


def test_packing_takes_every_row(spark, sf, odd):
    out = STAGES["best_fit_packing"](spark, odd, sf).collect()
    assert sum(r.piece == 0 for r in out) == odd.count()


def test_a_text_under_a_repeated_id_is_not_lost(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "something else altogether")], "doc_id long, text string")
    assert plain(NgramJoin(5, 80).kept(rows)) == sorted(map(str, [r for r in rows.collect() if tuple(r) != (2, "a b c d e f g")]))


def test_very_common_grams(spark, monkeypatch):
    """Grams that a sample shows to be common, and ones that are not, give the same groups."""
    from loomwright.llm import ngram_join as module

    texts = [(k, " ".join(f"w{i}" for i in range(30)) + f" n{k} m{k % 5}") for k in range(120)] + [(500 + k, f"q{k} " * 9) for k in range(20)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    found = []
    for common in (40, 10**9, 1):
        monkeypatch.setattr(module, "COMMON", common)
        found.append(sorted(map(tuple, NgramJoin(3, 80)(rows).collect())))
    assert found[0] == found[1] == found[2] and {c for k, _, c in found[0] if k < 120} == {0}


def test_license_scan_with_own_helper_names(spark, odd):
    out = LicenseScan()(odd)
    assert out.count() == odd.count() and {r._words for r in out.select("_words").collect()} == {"w"}


def test_clean_with_own_marks(spark, odd, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert Decontaminate().clean(odd, bench).columns == odd.columns
