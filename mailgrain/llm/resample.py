"""Importance resampling of documents towards a target: which ones look most like the benchmark's texts?

1. Features are a text's runs of words, hashed to buckets by CRC-32 (``word_runs``); each text is scanned once, and a run's
   CRC follows from the registers at its two ends (``prefix_crc``).
2. Corpus and target are counted by bucket. Every task hands on at most one number for each bucket.
3. A bucket's gain is the log ratio of its smoothed shares in target and corpus, in thousandths. A document's weight is
   the sum over its features.
4. Adding Gumbel noise from the document's id and taking the highest scores draws without replacement in proportion to
   the weights. Scores are ranked by a range shuffle: places in each range, plus what the ranges before it hold.

Only the gains (``buckets`` numbers) and the sizes of the ranges go to the executors as a whole. Defined results: null and
empty texts have no features, weight 0 and are never drawn; a null id draws its noise as an empty text; rows that share
an id share the noise, are each scored and, where their scores are equal too, ranked in any order without gaps; without
target or corpus every count is 0, so all gains are alike; an empty table gives an empty result; other columns are
ignored. A text longer than ``SLICE_BYTES`` is scanned in parts, so memory does not grow with it, but for a single
word of that length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailgrain.llm import word_runs
from mailgrain.llm.tables import stored

SLICE_BYTES = 512 << 10


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    parts = docs.select("text").mapInArrow(lambda it: word_runs.counted(it, longest, buckets, SLICE_BYTES), "bucket long, n long")
    total = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of each bucket's share in the target over that in the corpus, one added to every count."""
    s, t, n = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... in the given full order; no task orders more than one range of it."""
    # The number that Spark gives to sorted rows is the range's number and, in its lower 33 bits, the place within it.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at") - F.shiftleft("_range", 33))
    placed = stored(placed, "ranges")
    sizes = placed.groupBy("_range").agg((F.max("_at") + 1).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    # One row for each range, so its size is bounded by the number of partitions.
    return placed.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024
) -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, rank`` for every row of ``docs`` (doc_id, text); ``rank`` is null where the
    row is not drawn. ``target`` has a column ``text``."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    model = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda it: word_runs.weighed(it, model.value, longest, SLICE_BYTES), "doc_id long, n_features long, n_words long, weight long"
    )
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "weights")
    able = F.col("n_words") >= least_words
    drawn = rows.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc()]
    # Rows beyond the drawn ones keep no rank, so they need not be told apart from rows that are too short.
    placed = ranked(rows.filter(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_features", "n_words", "weight", "score"]
    short = rows.filter(~able).select(*names, F.lit(None).cast("long").alias("rank"))
    return placed.select(*names, "rank").unionByName(short)
