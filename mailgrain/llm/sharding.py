"""Shards by a weighted hash tree: region, rack and shard are drawn level by level.

At each node a key draws a number for every child and goes to the child with the smallest
``-ln(draw) / weight``; a node's weight is the sum of its leaves. The draw depends only on the key and the
child's name. So a changed weight moves keys only into or out of the subtree that changed: all other
children of a node keep their draws. A shard that is added comes as a subtree of its own below the root, so
rows move only into it.

Law: ``key`` - the id and the tree decide. Defined results: a null text counts as no bytes, a null id as
the key ``null``; repeated rows share a shard and get slots of their own; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

RACKS_PER_REGION, SHARDS_PER_RACK = 4, 5
#: A shard's slots are dealt in 16**3 slices, so no task orders a whole shard.
SLICE_DIGITS = 3
#: Equal rows get their slots in runs of this many, so that no list of slots grows with their number.
RUN = 4096


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int) -> list[Leaf]:
    """Equal shards, filled rack by rack and region by region."""
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    return [
        Leaf(f"region{i // per_region}", f"region{i // per_region}/rack{i // SHARDS_PER_RACK}", i) for i in range(shards)
    ]


def with_added(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"added{new}", f"added{new}/rack", new, weight)]


def _node(name: str, leaves: list[Leaf], **more: Column) -> Column:
    weight = F.lit(float(sum(leaf.weight for leaf in leaves))).alias("weight")
    return F.struct(F.lit(name).alias("name"), weight, *(c.alias(k) for k, c in more.items()))


def _groups(leaves: list[Leaf], level: str) -> list[tuple[str, list[Leaf]]]:
    names = dict.fromkeys(getattr(leaf, level) for leaf in leaves)
    return [(name, [leaf for leaf in leaves if getattr(leaf, level) == name]) for name in names]


def _tree(leaves: list[Leaf]) -> Column:
    """The tree as one nested literal."""

    def shards(group: list[Leaf]) -> Column:
        return F.array(*(_node(f"shard{leaf.shard}", [leaf], shard=F.lit(leaf.shard)) for leaf in group))

    def racks(group: list[Leaf]) -> Column:
        return F.array(*(_node(name, own, children=shards(own)) for name, own in _groups(group, "rack")))

    return F.array(*(_node(name, own, children=racks(own)) for name, own in _groups(leaves, "region")))


def draw(key: Column, name: Column) -> Column:
    """A number between 0 and 1 from 52 bits of the digest of key and child."""
    digits = F.substring(F.md5(F.concat_ws("/", key, name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _chosen(key: Column, children: Column) -> Column:
    cost = lambda child: -F.log(draw(key, child["name"])) / child["weight"]
    return F.array_min(F.transform(children, lambda c: F.struct(cost(c).alias("cost"), c.alias("child"))))["child"]


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """Descend region, rack and shard; every level looks only at the children of the node before."""
    region = _chosen(key, _tree(tree))
    rack = _chosen(key, region["children"])
    return _chosen(key, rack["children"])["shard"]


def placed(docs: DataFrame, tree: list[Leaf]) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs`` (doc_id, text).

    Slots count from 0 within a shard. Rows equal in id, size and checksum are counted before the shuffle and become
    rows again at the end, so neither a repeated row nor a repeated id with many texts loads one task: slices go by id and
    checksum. The slices' counts are added up first, and each slice is ordered on its own; only narrow rows are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    alike = narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = alike.select(
        "*",
        # Never null; said so, or the join below would test it with a second descent.
        F.coalesce(shard_of(key, tree), F.lit(-1)).alias("shard"),
        shard_of(key, with_added(tree)).alias("grown_shard"),
        F.coalesce(F.substring(F.md5(F.concat_ws("/", key, "text_crc32")), 1, SLICE_DIGITS), F.lit("")).alias("slice"),
    )
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy("shard", "slice").agg(F.sum("n").alias("n"))
    starts = counts.select("shard", "slice", earlier(Window.partitionBy("shard").orderBy("slice")).alias("start"))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    dealt = rows.withColumn("before", earlier(order)).join(starts, ["shard", "slice"])
    first = F.col("start") + F.col("before")
    runs = dealt.withColumn("run", F.explode(F.sequence(first, first + F.col("n") - 1, F.lit(RUN).cast("long"))))
    last = F.least(F.col("run") + RUN, first + F.col("n")) - 1
    return runs.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("run", last)).alias("slot"), "grown_shard"
    )
