"""I-Match fingerprints: terms of middling rarity, sorted and hashed over randomised lexicon subsets.

1. For every term (a lower-cased word) the documents that hold it are counted over the whole corpus. The lexicon
   is the terms whose inverse document frequency ``ln(N / df)`` lies in a band. The band is relative, so the
   lexicon has at most 1 / ``LEAST_SHARE`` times as many terms as a document has on average, whatever the corpus.
2. A text keeps its distinct terms that are in the lexicon (all its terms if none is), sorted.
3. The lexicon is cut into random subsets at several rates. Each subset's terms of the text are hashed to one
   part of the fingerprint; a part without terms is empty.

Two texts are alike in the share of equal parts among those that either fills, at the sparsest rate at which enough
parts are filled: there a part holds about one term, and the share estimates how many terms are common.

Everything runs as column expressions. Defined results: a null text is an empty text; empty texts have the
empty fingerprint, and equal fingerprints have likeness 1; documents with one id are ordered by a hash of their texts,
a null id comes last, repeated rows are one place in the order and get the same result each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailgrain.functions.text import exploded, let
from mailgrain.llm.columns import words
from mailgrain.llm.tables import stored

#: The band: terms in at least one of 200 documents and at most one of 10.
LEAST_SHARE, MOST_SHARE = 0.005, 0.1
#: Sixteen subsets at each rate; a subset holds one of so many terms.
SUBSETS, RATES = 16, (16, 64, 256, 1024, 4096)
FILLED = 8
#: Bits of a part.
BITS = 24
SLOTS = 1 << 14


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame) -> Column:
    """The terms of the band as a constant: lists of term hashes by their lowest bits. Only these terms leave the
    cluster, and the band bounds their number."""
    each = exploded(docs, terms(F.col("text")), "term")
    n = docs.count()
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counts.filter(F.col("df").between(LEAST_SHARE * n, MOST_SHARE * n)).select("term")
    lists = [[] for _ in range(SLOTS)]
    for row in band.collect():
        lists[row["term"] % SLOTS].append(row["term"])
    return F.from_json(F.lit(str(lists)), "array<array<bigint>>")


def parts(text: Column, chosen: Column) -> Column:
    """The fingerprint of a text as an array: for each rate and subset the hash of the sorted terms, or null."""
    slot = lambda t: t.bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    known = lambda t: F.filter(t, lambda x: F.array_contains(F.get(chosen, slot(x)), x))
    kept = let(terms(text), lambda t: let(known(t), lambda k: F.array_sort(F.when(F.size(k) > 0, k).otherwise(t))))

    def at_rate(all_terms: Column, rate: int) -> Column:
        place = lambda x: F.pmod(F.xxhash64(x, F.lit(rate)), F.lit(rate)).cast("int")
        entries = F.transform(all_terms, lambda x: F.struct(place(x).alias("subset"), x.alias("term")))
        used = F.filter(entries, lambda e: e["subset"] < SUBSETS)
        digest = lambda t: F.hash(t).bitwiseAND(F.lit((1 << BITS) - 1))
        one = lambda u, r: let(F.filter(u, lambda e: e["subset"] == r), lambda p: F.when(F.size(p) > 0, digest(p["term"])))
        return let(used, lambda u: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda r: one(u, r)))

    return let(kept, lambda k: F.concat(*(at_rate(k, rate) for rate in RATES)))


def likeness(one: Column, other: Column) -> Column:
    """From 0 to 1, between two fingerprints given as arrays."""
    pairs = F.arrays_zip(one.alias("a"), other.alias("b"))
    shares, filled = [], []
    for i in range(len(RATES)):
        own = F.slice(pairs, 1 + i * SUBSETS, SUBSETS)
        either = F.size(F.filter(own, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
        same = F.size(F.filter(own, lambda p: p["a"] == p["b"]))
        shares.append(F.coalesce(F.try_divide(same, either), F.lit(0.0)))
        filled.append(either >= FILLED)
    share = shares[0]
    for enough, at_rate in zip(filled, shares):
        share = F.when(enough, at_rate).otherwise(share)
    return F.when(one == other, 1.0).otherwise(share).cast("double")


def spelled(fingerprint: Column) -> Column:
    """As text: hex digits for each part, a dash for an empty one."""
    digits = lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))
    return F.array_join(F.transform(fingerprint, lambda x: F.coalesce(digits(x), F.lit("-"))), "")


def followers(rows: DataFrame) -> DataFrame:
    """``doc_id, key, of_id, of_key, need``: every document with the one that it follows in descending order
    of ids, the first one following the last, and a third of that one's length.

    Rows are cut into ranges; only each range's first row is compared across ranges.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    narrow = rows.select("doc_id", "key", F.floor(F.col("n_chars") / 3).cast("int").alias("need")).distinct()
    ranged = stored(narrow.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "order")
    # In this order the first row has the largest id; a null id counts below all others.
    rank = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "key", "need")
    ends = ranged.groupBy("range").agg(F.min(rank).alias("last"))
    before = F.lag("last").over(Window.orderBy("range"))
    very_last = F.first("last").over(Window.orderBy(F.col("range").desc()))
    ends = ends.select("range", F.coalesce(before, very_last).alias("edge"))
    own = Window.partitionBy("range").orderBy(*order)
    inside = F.lag(F.struct("doc_id", "key", "need")).over(own)
    linked = ranged.withColumn("inside", inside).join(ends, "range")
    edge = F.struct("edge.doc_id", "edge.key", "edge.need")
    return linked.withColumn("of", F.coalesce("inside", edge)).select(
        "doc_id", "key", F.col("of.doc_id").alias("of_id"), F.col("of.key").alias("of_key"), F.col("of.need").alias("need")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row
    of ``docs`` (doc_id, text). The edited text is the text with its last third replaced by the beginning of the next.

    Texts are shuffled once, without their fingerprints, which are computed behind it on either side; what a text's
    predecessor needs of it, a beginning and the fingerprint, is sent on.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = lexicon(texts)
    keyed = texts.withColumn("key", F.xxhash64("text"))
    links = stored(followers(keyed.withColumn("n_chars", F.length("text"))), "followers")
    printed = lambda rows: rows.withColumn("parts", parts(F.col("text"), chosen))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["id"]) & (a["key"] == b["the_key"])
    renamed = links.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "the_key")
    sent = (
        printed(keyed.join(renamed, same(keyed, renamed)))
        .groupBy(F.col("of_id").alias("id"), F.col("of_key").alias("the_key"))
        .agg(F.first(F.struct(F.expr("substring(text, 1, need)").alias("head"), F.col("parts").alias("next_parts"))).alias("next"))
    )
    length = F.length("text")
    kept = F.substring("text", F.lit(1), length - F.floor(length / 3).cast("int"))
    joined = printed(keyed.join(sent, same(keyed, sent))).withColumn("edited", F.concat(kept, F.col("next.head")))
    done = joined.withColumn("edited_parts", parts(F.col("edited"), chosen))
    return done.select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spelled(F.col("parts")).alias("fingerprint"),
        spelled(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next.next_parts")).alias("near_next"),
    )
