"""Cleaning a corpus in stages; each works on all rows that the stage before it kept.

1. Documents whose quality score is below a half go.
2. One document of each group of near duplicates stays.
3. Documents that hold a benchmark item go, with every row that has such a document's id.
4. Secrets are masked in the text, and ``n_chars`` follows it.
5. Texts are cut into sampled vocabulary pieces, and the text is decoded from them.

The stages before the last return the columns of ``documents``. An empty table stays empty; what null ids, null or
empty texts and repeated rows mean is said at the operators. Other columns than those of ``documents`` are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailgrain.llm import decontaminate, near_dedup, piece_sampling, quality, secret_scan
from mailgrain.llm.tables import stored, table, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = quality.with_scores(docs, table(spark, sf_dir, "labels"), COLUMNS)
    return scores.filter("score >= 0.5").select(COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs.select(COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    found = stored(leaks.select(F.col("doc_id").alias("_id")).distinct(), "leaks")
    return docs.select(COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(docs, COLUMNS)
    found = found.withColumn("text", secret_scan.masked(F.col("text"), F.col("spans")))
    changed = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = piece_sampling.encode(docs.select(COLUMNS), vocabulary(), F.col("doc_id"), F.col("text"))
    # Stored, so that no task holds two Python workers at once: Spark keeps idle ones, with their memory, for later stages.
    coded = stored(coded.withColumn("n_pieces", F.size("pieces")), "pieces")
    return piece_sampling.decode(coded, vocabulary(), keep_pieces=True).select(*COLUMNS, "n_pieces", "pieces")


STAGES: list[tuple[str, Stage]] = [
    (f.__name__, f) for f in (quality_classifier, minhash_near_dedup, benchmark_decontamination, secret_scans, sentencepiece)
]
#: The classifier's network and the sampled pieces are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
