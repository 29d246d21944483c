"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

1. Every word's vector is the sum, over the whole corpus, of the fixed sparse index vectors of its neighbours.
   Each task adds up its own texts and hands on one table of fixed size; tables are added in a tree.
2. The vectors are pooled per document (``quality_net.pooled``).
3. A network learns ``labels.quality`` from at most ``sample`` labelled documents, those with the smallest
   hashes, and its probabilities are calibrated by a temperature on rows kept out of the training. Of an id with
   several rows the text with the smallest hash is learned from.
4. Every document is scored.

Only the text goes into a score. Documents whose ``crc32(doc_id) mod 3`` is 1 give no label. Defined
results: null and empty texts have a zero pool and the score that the network gives it; labels that are null, or
repeated with different values, are left out; without labels of both kinds every score is the share of label 1 (a half
if there are none); repeated rows are scored alike; the columns asked for are carried along, but for one named ``score``. A text longer
than ``SLICE_BYTES`` is worked on in parts that end at blanks, so memory does not grow with it, but for a stretch without blanks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from mailgrain.llm import quality_net as N

SLICE_BYTES, BLOCK, FAN_IN = 256 << 10, 8192, 256


def held_out(doc_id: Column) -> Column:
    """Whether the row's label must not be learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, ``BUCKETS`` x ``WIDTH`` numbers whatever the size of the corpus."""
    schema = "task long, block long, sums array<long>"
    parts = docs.select("text").mapInArrow(lambda it: N.gathered(it, BLOCK, SLICE_BYTES), schema)
    parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN))
    parts = parts.groupBy("task", "block").applyInArrow(N.added, schema)
    rows = parts.drop("task").groupBy("block").applyInArrow(N.added, "block long, sums array<long>").collect()
    total = np.zeros(N.BUCKETS * N.WIDTH, np.int64)
    for row in rows:
        total[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = row["sums"]
    return N.vectors(total)


def learned(docs: DataFrame, labels: DataFrame, table: np.ndarray, sample: int) -> N.Net:
    """The network, from at most ``sample`` labelled documents that are not held out."""
    given = (
        labels.select(F.col("doc_id").alias("_id"), "quality")
        .filter(F.col("_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
        .select("_id", F.col("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    # At most ``sample`` rows, and an id may hold much of the corpus, so texts are not dealt by id.
    rows = docs.select("doc_id", "text").join(F.broadcast(given), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_id", F.xxhash64("text").alias("_hash"), "label", "text")
    schema = StructType(rows.schema.fields[:-1]).add("pool", ArrayType(DoubleType()))
    pools = rows.mapInArrow(lambda it: N.features(it, table, SLICE_BYTES), schema)
    # One text for each id, whatever holds its rows; each task keeps one row of an id before pools are moved.
    pools = pools.groupBy("_id").agg(F.min(F.struct("_hash", "label", "pool")).alias("p")).select("p.label", "p.pool").toArrow()
    y = pools.column("label").to_numpy()
    x = pools.column("pool").combine_chunks().flatten().to_numpy().reshape(len(y), N.FEATURES)
    order = np.lexsort((*x.T[:3], y))
    return N.fit(x[order], y[order])


def with_scores(docs: DataFrame, labels: DataFrame, keep: list[str], sample: int = 20_000) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (doc_id, text) with ``score``, the calibrated chance of label 1."""
    spark = docs.sparkSession
    table = word_vectors(docs)
    net = learned(docs, labels, table, sample)
    model = spark.sparkContext.broadcast((table, vars(net)))
    keep = [c for c in keep if c != "score"]
    schema = StructType([docs.schema[c] for c in keep]).add("score", DoubleType())
    given = docs.select(*dict.fromkeys([*keep, "text"]))
    return given.mapInArrow(lambda it: N.scored(it, *model.value, keep, SLICE_BYTES), schema)
