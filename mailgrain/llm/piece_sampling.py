"""Sampled segmentation into vocabulary pieces, and decoding without loss (see ``pieces``).

All segmentations of a text into pieces form a lattice; one is sampled with a chance in proportion to the
product of its pieces' weights raised to ``sharpness``: sums of weights run forward, borders are drawn
backward. Draws depend on the row key, the seed and the place in the text only, so results do not change with
partitioning, batches or retried tasks. Characters the vocabulary lacks, and space marks in the text itself,
are spelled as byte pieces; so decoding gives back the very text.

Defined results: a null text is an empty text and has no pieces, null pieces decode to a null text; a null key is
a key like any other, and repeated rows get the same pieces; any other columns are carried along, except that
``pieces`` and ``text`` are replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from mailgrain.llm import pieces

SLICE_BYTES, SLICE_PIECES = 512 << 10, 256 << 10


def _others(frame: DataFrame, *taken: str) -> list[str]:
    return [c for c in frame.columns if c not in taken]


def encode(
    rows: DataFrame, vocabulary_path: str, key: Column, text: Column, sharpness: float = 1.0, seed: int = 0
) -> DataFrame:
    """The columns of ``rows`` but ``text``, and ``pieces`` of the given text sampled by the given key."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(vars(pieces.load(vocabulary_path)))
    rest = _others(rows, "text", "pieces")
    given = rows.select(F.xxhash64(F.lit(seed), key).alias("_seed"), text.alias("_text"), *(F.col(f"`{c}`") for c in rest))
    schema = StructType([rows.schema[c] for c in rest]).add("pieces", ArrayType(IntegerType()))
    return given.mapInArrow(lambda it: pieces.encoded(it, vocabulary, sharpness, SLICE_BYTES), schema)


def decode(rows: DataFrame, vocabulary_path: str, keep_pieces: bool = False) -> DataFrame:
    """The columns of ``rows``, with ``pieces`` if asked for, and the ``text`` that the pieces spell."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(vars(pieces.load(vocabulary_path)))
    rest = _others(rows, "text", *([] if keep_pieces else ["pieces"]))
    schema = StructType([rows.schema[c] for c in rest]).add("text", StringType())
    given = rows.select(F.col("pieces").alias("_pieces"), *(F.col(f"`{c}`") for c in rest))
    return given.mapInArrow(lambda it: pieces.decoded(it, vocabulary, SLICE_PIECES), schema)
