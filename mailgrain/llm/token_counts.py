"""Token counts of whole texts by merging pre-tokens rank by rank, in step, on ragged arrays (see ``pieces``).

Counts equal those of the vocabulary's own library for the whole text: no begin, end or added special
tokens, and special strings inside a text are ordinary text. Defined results: a null text is an empty
text and has 0 bytes and 0 tokens; rows with null or repeated ids are counted like any other; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailgrain.llm import pieces

SLICE_BYTES, REMEMBERED = 1 << 20, 1 << 20


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (doc_id, text).

    The vocabulary's arrays are sent to the executors; the file bounds their size.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(vars(pieces.load(vocabulary_path)))
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    counted = rows.mapInArrow(
        lambda it: pieces.counted(it, vocabulary, SLICE_BYTES, REMEMBERED), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
