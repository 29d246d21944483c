"""One named query per operator, over its whole table, and SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailgrain.llm import (
    chat, decontaminate, hard_negatives, imatch, near_dedup, piece_sampling, pii, quality, resample, secret_scan, sharding, token_counts,
    warc,
)
from mailgrain.llm.oracles import ORACLES  # noqa: F401
from mailgrain.llm.tables import table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality.with_scores(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return scores.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"), ["doc_id"])
    spans = F.col("spans")
    number = lambda no: F.size(F.filter(spans, lambda s: s["kind_no"] == no)).cast("long")
    of_class = lambda name: F.size(F.filter(spans, lambda s: s["class"] == name)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(secret_scan.written(spans, only_base=True), 256).alias("base_sha256"),
        secret_scan.written(spans).alias("spans"),
        of_class("live").alias("n_live"), of_class("copied").alias("n_copied"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(table(spark, sf_dir, "documents"), sharding.layout(40))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = chat.formatted(chat.chosen_paths(chat.linear(turns.unionByName(planted))))
    back = done.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(chat.turns_text(F.col("turns")), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "text", F.length("text").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
    coded = piece_sampling.encode(rows, vocabulary(), F.col("doc_id"), F.col("text"))
    coded = coded.select("*", F.size("pieces").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"))
    back = piece_sampling.decode(coded, vocabulary())
    decoded = F.sha2("text", 256)
    return back.select(
        "doc_id", "n_chars", "n_pieces", "pieces_hash", decoded.alias("decoded_sha256"),
        (decoded == F.col("text_sha256")).alias("lossless"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scanned(table(spark, sf_dir, "documents"), pii.trained(pii.labelled(spark)), ["doc_id"])
    spans = F.col("spans")
    return found.select(
        "doc_id", *(pii.number(spans, kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(pii.written(spans, only_base=True), 256).alias("base_sha256"), pii.written(spans).alias("spans"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"), scale=256, flip_every=7)
    return hard_negatives.mined(rows)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_quality_classifier, op3_minhash_near_dedup, op4_secret_scans,
        op5_document_fingerprints, op6_sharding, op7_warc, op8_chat_formatting, op9_sentencepiece, op10_token_counts,
        op11_importance_resampling, op12_personal_data, op13_hard_negatives,
    )
}
