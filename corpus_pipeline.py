"""Corpus preparation: toxic documents go, near copies go, benchmark passages go, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.decontaminate import Decontaminate
from loomwright.llm.ngram_join import NgramJoin
from loomwright.llm.packing import BestFitPacking
from loomwright.llm.queries import table, vocabulary
from loomwright.llm.secret_scan import SecretScan
from loomwright.llm.toxicity import Toxicity
from loomwright.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; the others keep all their columns, ones named ``score`` or ``predicted`` too.

    NULL and empty texts are scored like any other and stay where the model has no reason to reject them; repeated rows
    share a score; whole texts are read, however long. An empty table stays empty.
    """
    return Toxicity().accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays.

    Rows go one by one: another text under the same id stays. Rows without words (NULL and empty texts) are no copies of each
    other, rows without id and repeated rows of the document that stays are kept. Other columns may have any names.
    """
    return NgramJoin(size=5, percent=80).kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, judged row by row; the others keep all their columns, whatever their names.

    NULL and empty texts have no words and are clean; repeated rows are judged alike; an empty benchmark leaves all.
    """
    return Decontaminate().clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every row stays, with all its columns and its new length as ``n_chars`` if it has that column.

    NULL and empty texts have no secrets and stay as they are (the length of NULL is NULL).
    """
    masked = SecretScan().redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of at most 4096 tokens.

    Every row is packed, repeated ones and ones without id too; NULL and empty texts are one end token; long texts are cut
    into pieces of 4096 tokens. An empty table has no pieces.
    """
    return BestFitPacking(vocabulary("word_bpe_49k.json"))(docs)


STAGES = (
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
)

#: models and tokens are beyond SQL; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
