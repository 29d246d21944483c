"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Texts are lower-cased and cut into words at ASCII white space; the set of a text is its distinct shingles of
five words (fewer words: the whole sequence; none: empty). An item is found in a document that holds at
least 75 % of the item's shingles, wherever they stand and however long the document is. An item of one to four words is
its one shingle; it is found wherever its words stand next to each other, in a document of any length.

An ordinary signature of a long document says nothing about a short item in it. So the signature belongs to
the item: its ``n - ceil(0.75 n) + 1`` smallest shingle hashes. A document with 75 % of the shingles cannot miss
all of those, so looking up each shingle hash of a document in the signatures finds every item: there
is no chance of a miss. Items are partitioned by size (powers of two); each partition has its own hash bound,
the largest hash of its signatures, and its own least document size, so a document is searched only against the
partitions that can be inside it and only with hashes below their bounds. Items of fewer than five words are partitions
by their number of words: documents are searched by their stretches of just those lengths that occur among the items.
Candidate pairs are confirmed on the shingles themselves, and those of short items on the words.

The signatures are a stored table: Spark broadcasts it while it is under its size threshold and shuffles
hashes otherwise, each entry copied so that a hash in a third of all documents is spread. All is column expressions. Defined results: null or empty texts hold nothing and are in
nothing; of rows with the same id (null included) the best containment counts; repeated items with one id
likewise; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.functions.text import exploded, let
from mailgrain.llm.columns import words
from mailgrain.llm.tables import stored
from mailgrain.operators.joins import copied_join

WIDTH, SHARE_PER_CENT = 5, 75


def _stretches(of: Column, whole: Column, one: Callable[[Column], Column]) -> Column:
    """``one`` of every start of five neighbours in the list ``of``; the list's ``whole`` if it is shorter."""
    many = F.transform(F.sequence(F.lit(0), F.size(of) - WIDTH), one)
    return F.when(F.size(of) >= WIDTH, many).when(F.size(of) > 0, F.array(whole)).otherwise(F.filter(F.array(whole), lambda _: F.lit(False)))


def shingles(text: Column) -> Column:
    """All shingles of a text in order, repeats included."""
    joined = lambda w: _stretches(w, F.array_join(w, " "), lambda i: F.array_join(F.slice(w, i + 1, WIDTH), " "))
    return let(words(text), joined)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashed: Column) -> Column:
    """A hash of each shingle, from the hashes of its words; each word is hashed once."""
    five = lambda h, i: F.xxhash64(*(F.get(h, i + k) for k in range(WIDTH)))
    return let(hashed, lambda h: _stretches(h, F.xxhash64(h), lambda i: five(h, i)))


def run_hashes(hashed: Column, length: int) -> Column:
    """The distinct hashes of ``length`` neighbours, at a length below five; equal to the shingle hash of a text of just these words."""
    starts = F.sequence(F.lit(1), F.size(hashed) - length + 1)
    runs = F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, length)))
    return F.when(F.size(hashed) >= length, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def needed(n: Column) -> Column:
    """How many of an item's n shingles a document must hold."""
    return F.ceil(n * SHARE_PER_CENT / 100).cast("int")


def signatures(items: DataFrame) -> DataFrame:
    """``item, item_id, item_text, n_words, n, part, hashes`` of every item with words; ``hashes`` is its signature.

    ``part`` is the binary logarithm of ``n``; of items of fewer than five words it is their number of words, negative.
    """
    hashed = word_hashes(F.col("text"))
    sets = items.select(
        "item_id", F.col("text").alias("item_text"), F.size(hashed).alias("n_words"), F.array_distinct(shingle_hashes(hashed)).alias("own")
    )
    sets = sets.withColumn("n", F.size("own")).filter("n > 0")
    return sets.select(
        F.monotonically_increasing_id().alias("item"),
        "item_id",
        "item_text",
        "n_words",
        "n",
        F.when(F.col("n_words") < WIDTH, -F.col("n_words")).otherwise(F.floor(F.log2("n")).cast("int")).alias("part"),
        F.slice(F.array_sort("own"), 1, F.col("n") - needed(F.col("n")) + 1).alias("hashes"),
    )


def candidates(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """``doc_id, item`` wherever a document has a hash of an item's signature."""
    entries = stored(signed.select("item", "n", "part", F.explode("hashes").alias("hash")), "signatures")
    # At most 35 partitions: sizes are powers of two, or one to four words.
    parts = entries.groupBy("part").agg(F.max("hash").alias("bound"), F.min(needed(F.col("n"))).alias("least")).collect()
    if not parts:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item")).limit(0)
    entry = lambda h, size: F.struct(h.alias("hash"), size.alias("size"))

    def searched(own: Column) -> Column:
        """The hashes below the bounds of the partitions that fit into the document, with its size."""
        size = F.size(own)
        bounds = [F.when(size >= p["least"], F.lit(p["bound"])) for p in parts if p["part"] >= 0]
        bound = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
        low = let(bound, lambda b: F.filter(own, lambda h: h <= b))
        return F.transform(low, lambda h: entry(h, size))

    def short(hashed: Column, length: int, bound: Column) -> Column:
        return F.transform(F.filter(run_hashes(hashed, length), lambda h: h <= bound), lambda h: entry(h, F.lit(1)))

    def looked_up(hashed: Column) -> Column:
        """What is looked up of a document: its shingles, and its runs as long as the short items."""
        lists = [let(shingle_hashes(hashed), searched)] if any(p["part"] >= 0 for p in parts) else []
        lists += [short(hashed, -p["part"], F.lit(p["bound"])) for p in parts if p["part"] < 0]
        whole = [F.coalesce(one, F.array().cast("array<struct<hash:bigint,size:int>>")) for one in lists]
        return F.concat(*whole) if len(lists) > 1 else lists[0]

    each = exploded(docs, let(word_hashes(F.col("text")), looked_up), "entry", "doc_id").select("doc_id", "entry.*")
    known = entries.select("hash", "item", needed(F.col("n")).alias("need"))
    hits = copied_join(each, known, ["hash"], F.xxhash64("doc_id", "size")).filter("size >= need")
    return hits.select("doc_id", "item").distinct()


def shared_shingles(item: Column, text: Column) -> Column:
    """How many of an item's shingles a text holds; of a short item, whether its words stand in it as neighbours."""
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(words(t), " "), F.lit(" "))
    both = F.size(F.array_intersect(shingles(item), shingles(text)))
    return F.when(F.col("n_words") < WIDTH, F.contains(spaced(text), spaced(item)).cast("int")).otherwise(both)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of every item found in ``docs`` (doc_id, text)."""
    signed = stored(signatures(items), "items")
    pairs = candidates(docs, signed).join(signed.select("item", "item_id", "item_text", "n_words", "n"), "item")
    pairs = stored(pairs.withColumnRenamed("doc_id", "of"), "candidates")
    texts = docs.select("doc_id", "text").join(pairs, F.col("doc_id").eqNullSafe(F.col("of")))
    shared = shared_shingles(F.col("item_text"), F.col("text"))
    return (
        texts.select("doc_id", "item_id", F.col("n").alias("n_shingles"), shared.alias("n_shared"))
        .filter(F.col("n_shared") >= needed(F.col("n_shingles")))
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
        .select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")
    )
