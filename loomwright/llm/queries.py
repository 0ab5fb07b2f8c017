"""One query per operator over the driver's tables, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.conversation_repair import ConversationRepair, dealt_damage
from loomwright.llm.conversation_sql import REPAIR, TRIE
from loomwright.llm.conversation_trie import ConversationTrie
from loomwright.llm.decontaminate import Decontaminate
from loomwright.llm.language import Languages
from loomwright.llm.learning import held_out
from loomwright.llm.licenses import LicenseScan
from loomwright.llm.neighbours import NeighbourGraph
from loomwright.llm.ngram_join import NgramJoin
from loomwright.llm.packing import BestFitPacking
from loomwright.llm.quality import Quality
from loomwright.llm.secret_scan import PATTERNS, SecretScan
from loomwright.llm.simhash import SimHash
from loomwright.llm.token_counts import TokenCounts
from loomwright.llm.toxicity import Toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(size=3, percent=90)(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = Toxicity(parts=3, part=1)(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.withColumn("held_out", held_out("doc_id", 3, 1)).select("doc_id", "held_out", "score", "predicted")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = Quality(parts=4, part=2)(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return scored.withColumn("held_out", held_out("doc_id", 4, 2)).select("doc_id", "held_out", "score", "predicted")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BestFitPacking(vocabulary("word_bpe_49k.json"), capacity=4096, end=1)(table(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Languages(parts=5, part=0)(table(spark, sf_dir, "documents"), keep=("doc_id",)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LicenseScan()(table(spark, sf_dir, "documents"), keep=("doc_id",))


def secret_digest(scanned: DataFrame) -> DataFrame:
    kinds = [kind for kind, *_ in PATTERNS]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in kinds]
    return scanned.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(SecretScan()(table(spark, sf_dir, "documents"), keep=("doc_id",)))


@query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NeighbourGraph(most=20)(table(spark, sf_dir, "embeddings"), every=20)


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontaminate(width=13, share=20)(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TokenCounts(vocabulary("byte_bpe_50k.json"), limit=512)(table(spark, sf_dir, "documents"), keep=("doc_id",))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ConversationRepair()(table(spark, sf_dir, "conversations"), dealt_damage)


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ConversationTrie()(table(spark, sf_dir, "conversations"))


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SimHash(width=3, most=2)(table(spark, sf_dir, "documents"))


ORACLES["op11_conversation_repair"] = REPAIR
ORACLES["op12_conversation_trie"] = TRIE

#: words, windows and hits of every document in SQL; windows are compared as lists of words
ORACLES["op9_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
        FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
grams AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM pos, sizes WHERE i + k - 1 <= len(w)),
found AS (SELECT doc_id, i, grams.k, item_id FROM grams JOIN win ON grams.k = win.k AND grams.g = win.g),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
