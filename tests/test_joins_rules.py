"""Skew-proof joins and rules against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import joins as J
from mailgrain.operators import rules
from mailgrain.operators.rules import apply_rules


@pytest.fixture
def skewed(spark):
    """Half of all rows on one key, some without a key; a lookup with repeats and a missing key."""
    rows = [(i, "hot" if i % 2 else (None if i % 10 == 0 else f"k{i % 40}")) for i in range(2000)]
    big = spark.createDataFrame(rows, "id long, key string")
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k4", 3), ("zz", 4), (None, 5)], "key string, v int")
    return big, lookup


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("join", [J.salted_join, J.copied_join])
def test_same_as_plain_join(skewed, join, how):
    big, lookup = skewed
    got = join(big, lookup, ["key"], F.col("id"), how).select("id", "key", "v")
    want = big.join(lookup, "key", how).select("id", "key", "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_keys_are_bounded(skewed):
    assert [r["key"] for r in J.hot_keys(skewed[0], ["key"], 0.3).collect()] == ["hot"]
    assert J.hot_keys(skewed[0], ["key"], 0.01).count() <= 100


def test_hot_rows_spread(spark, skewed):
    big, lookup = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = J.salted_join(big, lookup, ["key"], F.col("id")).filter("key = 'hot'")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 2000 and len(sizes) >= 6


def test_pick_per_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}", f"row{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "seq long, key string, v string")
    last = {r["key"]: r["seq"] for r in J.pick_per_key(frame, ["key"], ["seq"], True).collect()}
    first = {r["key"]: r["seq"] for r in J.pick_per_key(frame, ["key"], ["seq"], False).collect()}
    assert last["hot"] == 299 and first["hot"] == 1 and len(last) == len(first) == 101


RULE = "id long, condition_type string, condition_value string, action_type string, action_value string, " \
    "is_active boolean, priority long"


def brute(mails, rules):
    best = {}
    for m in mails:
        for r in rules:
            ident, kind, value, action, result, active, priority = r
            if kind == "subject_contains":
                hit = value != "" and m[4] is not None and value.lower() in m[4].lower()
            else:
                hit = value == {"sender": m[1], "domain": m[2], "category": m[3]}[kind]
            if hit and active:
                key = (m[0], action)
                best[key] = min(best.get(key, (9**9,)), (priority, ident, result))
    return {key: (v[1], v[2]) for key, v in best.items()}


def test_rules_by_brute_force(spark):
    dice = random.Random(7)
    word = lambda: "".join(dice.choice("abé😀 ") for _ in range(dice.randint(0, 12)))
    mails = [(f"m{i}", dice.choice("xyz"), dice.choice("pq"), dice.choice("cd"), word()) for i in range(120)]
    mails.append(("none", None, None, None, None))
    kinds = {"sender": "xyzw", "domain": "pqr", "category": "cde"}
    rules = [
        (100 + i, kind, dice.choice(values), dice.choice(["label", "archive"]), f"v{i}", dice.random() > 0.2, dice.randint(0, 3))
        for i, (kind, values) in enumerate(list(kinds.items()) * 3)
    ]
    rules += [
        (200 + i, "subject_contains", word()[: dice.randint(0, 4)].upper(), "label", f"s{i}", True, dice.randint(0, 3))
        for i in range(25)
    ]
    frame = spark.createDataFrame(mails, "message_id string, sender string, domain string, category string, subject string")
    got = apply_rules(frame, spark.createDataFrame(rules, RULE))
    found = {(r["message_id"], r["action_type"]): (r["rule_id"], r["action_value"]) for r in got.collect()}
    assert found == brute(mails, rules) and found


def test_no_rules(spark):
    frame = spark.createDataFrame([("m", "s", "d", "c", "t")], "message_id string, sender string, domain string, category string, subject string")
    assert apply_rules(frame, spark.createDataFrame([], RULE)).count() == 0


def test_only_pieces_of_rules_become_rows(spark):
    """Rows out of the explode are near the hits, and no subject goes with them."""
    dice = random.Random(8)
    text = lambda n: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    mails = [("x", f"m{i}", text(200) + (" invoice" if i % 50 == 0 else "")) for i in range(500)]
    mail = spark.createDataFrame(mails, "account string, message_id string, subject string")
    pieces = spark.createDataFrame([("voi",), ("#9x",), ("é",)], "piece string")
    rows = rules.subject_pieces(mail, pieces)
    assert rows.columns == ["account", "message_id", "piece"]
    hits = sum("voi" in s for _, _, s in mails)
    assert hits <= rows.count() <= 2 * hits + 50
    assert rules.subject_pieces(mail, pieces.limit(0)).count() == 0
