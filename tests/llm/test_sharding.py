import math
import zlib
from collections import Counter
from hashlib import md5

from pyspark.sql import functions as F

from mailgrain.llm import sharding as S
from tests.llm.helpers import docs, read


def draw(key, name):
    return (int(md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute(key, tree):
    """Descend by the same draws, written plainly."""
    leaves = tree
    for level in ("region", "rack", "shard"):
        weights = {}
        for leaf in leaves:
            weights[getattr(leaf, level)] = weights.get(getattr(leaf, level), 0.0) + leaf.weight
        name = lambda n: f"shard{n}" if level == "shard" else n  # noqa: B023, E731
        best = min(weights, key=lambda n: (-math.log(draw(key, name(n))) / weights[n], name(n)))
        leaves = [leaf for leaf in leaves if getattr(leaf, level) == best]
    return leaves[0].shard


def test_smallest_tables_by_brute_force(spark):
    rows = read("documents", "doc_id, text")
    tree = S.layout(40)
    out = S.placed(docs(spark, rows), tree).collect()
    text = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert r["shard"] == brute(r["doc_id"], tree) and r["grown_shard"] == brute(r["doc_id"], S.with_added(tree))
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def shards(spark, tree, n=20000):
    rows = spark.range(n).select("id", S.shard_of(F.col("id").cast("string"), tree).alias("s"))
    return {r["id"]: r["s"] for r in rows.collect()}


def test_added_shard_takes_rows_only_into_itself_and_its_share(spark):
    tree = S.layout(40)
    before, after = shards(spark, tree), shards(spark, S.with_added(tree))
    moved = {after[i] for i in before if after[i] != before[i]}
    assert moved == {40}
    counts = Counter(after.values())
    assert len(counts) == 41 and all(abs(n - 20000 / 41) < 5 * math.sqrt(20000 / 41) for n in counts.values())


def test_changed_weight_moves_rows_only_through_its_subtree(spark):
    tree = S.layout(40)
    heavier = [S.Leaf(x.region, x.rack, x.shard, 3.0) if x.shard == 7 else x for x in tree]
    rack = {x.shard: x.rack for x in tree}
    region = {x.shard: x.region for x in tree}
    before, after = shards(spark, tree), shards(spark, heavier)
    for i in before:
        if before[i] != after[i]:
            assert region[after[i]] == region[7]
            if region[before[i]] == region[7]:
                assert rack[after[i]] == rack[7]
            if rack[before[i]] == rack[7]:
                assert after[i] == 7
    counts = Counter(after.values())
    assert counts[7] > 2 * counts[30]


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    rows = [(None, None, 1), (1, "é", 2), (1, "é", 2), (1, "other", 3), (2, "", 4)]
    out = S.placed(docs(spark, rows, "doc_id long, text string, shard int"), S.layout(3)).collect()
    assert len(out) == 5 and sorted(r["size"] for r in out) == [16, 16, 18, 18, 21]
    assert len({r["shard"] for r in out if r["doc_id"] == 1}) == 1
    per = Counter(r["shard"] for r in out)
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in sorted(per) for k in range(per[s])]
    assert S.placed(docs(spark, []), S.layout(40)).count() == 0


def test_one_id_with_many_rows_is_split(spark):
    same = spark.range(10000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("again and again").alias("text"))
    texts = spark.range(10000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    others = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = same.unionByName(texts).unionByName(others)
    out = S.placed(rows, S.layout(4))
    assert out.count() == 20100 and out.filter("doc_id = 5").select("shard").distinct().count() == 1
    assert out.filter("size = 31").count() == 10000
    per = out.groupBy("shard").agg(F.count("slot"), F.countDistinct("slot"), F.min("slot"), F.max("slot")).collect()
    assert all(r[1] == r[2] and r[3] == 0 and r[4] == r[1] - 1 for r in per)
