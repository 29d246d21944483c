"""Hard negatives: rows of another label that come close to an anchor's positives, but not too close.

1. Vectors become integers, and one row for each id is stored.
2. Anchors (a stated share of the ids) and rows are dealt over a grid of cells. A cell keeps its anchors in memory and reads
   its rows as a stream, so its size is bounded by ``ANCHORS``, whatever the number of rows. Scores are exact integer products
   of packed vectors (``packed``).
3. Every cell hands on each anchor's best few rows; cells are merged by a window over those few. This runs twice: for the
   positives, and for the negatives in the range of scores that each positive allows.

A cell holds one anchor block and one part of the rows; rows are copied once for each block of ``ANCHORS`` anchors, anchors
once for each part. Labels and vectors play no role in the dealing, so a label, or a vector that many ids share, loads no cell.

Defined results: rows with a null id take no part, nor do those with a null label, a null vector, or a null or non-finite
component; of several rows with one id the one with the smallest label, then vector, counts; a shorter vector counts as
ending in zeros; an empty vector scores 0 with all; ties go to the smaller id; an anchor without positives, or a positive
without negatives, gives no row; an empty table gives none; other columns are ignored. Components whose multiple passes 64
bits are the outermost number of 64 bits, and scores are then taken modulo 2**64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mailgrain.llm import packed
from mailgrain.llm.tables import stored

ANCHORS, PART_ROWS = 16_384, 1 << 20


def usable(rows: DataFrame, scale: int, flip_every: int = 0, labels: int = 10) -> DataFrame:
    """``id, label, vec`` of the rows (vec_id, embedding, label) that take part, one for each id. With ``flip_every`` the label
    of ids divisible by it is the next one of ``labels``."""
    label = F.col("label").cast("long")
    if flip_every:
        label = F.when(F.col("vec_id") % flip_every == 0, (label + 1) % labels).otherwise(label)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    vec = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.struct(label.alias("label"), vec.alias("vec")).alias("_own"))
    return rows.groupBy("id").agg(F.min("_own").alias("_own")).select("id", "_own.label", "_own.vec")


def _grid(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int) -> DataFrame:
    """One partition for each anchor block and part of the rows, its anchors first."""
    block, part = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = anchors.select("*", F.lit(0).alias("kind"), block.alias("block"), every(parts).alias("part"))
    read = rows.select("*", F.lit(1).alias("kind"), every(blocks).alias("block"), part.alias("part"))
    both = held.unionByName(read, allowMissingColumns=True)
    cell = (F.col("block") * parts + F.col("part")).cast("int")
    dealt = both.withColumn("cell", cell).repartitionById(blocks * parts, F.col("cell"))
    return dealt.sortWithinPartitions("kind").drop("block", "part", "cell")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchors_per_block: int = ANCHORS
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``rows`` are those of ``usable``; anchors
    are the ids divisible by ``every``, and a negative's score lies between ``low`` and ``high`` percent of the positive's."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    anchors = rows.filter(F.col("id") % every == 0)
    blocks = max(1, -(-anchors.count() // anchors_per_block))
    parts = max(-(-rows.count() // PART_ROWS), -(-2 * spark.sparkContext.defaultParallelism // blocks), 1)
    found = _grid(rows, anchors, blocks, parts).mapInArrow(
        lambda it: packed.positives(it, positives), "anchor_id long, score long, id long"
    )
    found = stored(_first(found, ["anchor_id"], positives), "positives")
    wanted = found.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("wanted"))
    asked = anchors.join(wanted.withColumnRenamed("anchor_id", "id"), "id")
    found = _grid(rows, asked, blocks, parts).mapInArrow(
        lambda it: packed.negatives(it, negatives, low, high),
        "anchor_id long, positive_id long, positive_score long, score long, id long",
    )
    best = _first(found, ["anchor_id", "positive_id"], negatives)
    return best.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
