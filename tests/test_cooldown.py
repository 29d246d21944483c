"""The cooldown against a plain loop per owner, with one owner that holds a third of all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import cooldown as D
from mailgrain.operators import senders as S

MINUTE = 60_000_000


def plain(rows, wait):
    out, last = set(), {}
    for owner, t in sorted(set(rows), key=lambda r: (str(r[0]), r[1])):
        if owner not in last or t - last[owner] >= wait:
            last[owner] = t
            out.add((owner, t))
    return out


def got(spark, rows, wait, span=D.HOUR):
    times = spark.createDataFrame(sorted(set(rows), key=str), "account string, t long")
    kept = D.taken(times, ["account"], wait, span).collect()
    assert len(kept) == len({tuple(r) for r in kept})
    return {tuple(r) for r in kept}


@pytest.mark.parametrize("span", [3 * MINUTE, D.HOUR])
def test_against_a_loop(spark, span):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(8 * 60) * MINUTE // 2) for _ in range(400)]  # a burst over hours
    rows += [(f"a{rng.randrange(6)}", rng.randrange(2000) * MINUTE) for _ in range(500)]
    rows += [(None, rng.randrange(300) * MINUTE) for _ in range(100)] + [("old", -rng.randrange(100) * MINUTE) for _ in range(60)]
    for wait in (5 * MINUTE, 90 * MINUTE):
        assert got(spark, rows, wait, span) == plain(rows, wait)


def test_edges(spark):
    m = MINUTE
    assert got(spark, [("a", 0), ("a", 5 * m - 1), ("a", 5 * m), ("a", 10 * m - 1)], 5 * m) == {("a", 0), ("a", 5 * m)}
    every = [("a", i * m) for i in range(58, 70)]  # across a slice's edge
    assert got(spark, every, 5 * m) == {("a", i * m) for i in (58, 63, 68)}
    assert got(spark, [("a", 59 * m), ("a", 179 * m), ("a", 181 * m), ("a", 184 * m)], 5 * m) == {("a", x * m) for x in (59, 179, 184)}
    assert got(spark, [], 5 * m) == set()


def test_feed_is_the_first_mail_of_each_taken_time(spark):
    start = datetime(2025, 1, 1)
    rows = [("a", f"m{i}", start + timedelta(minutes=(i // 2) * 2), i) for i in range(20)] + [("a", "none", None, 99), ("b", "m1", start, 0)]
    mail = spark.createDataFrame(rows, "account string, message_id string, date_received timestamp, seq long")
    mail = mail.withColumns({"sender": F.lit("s"), "subject": F.col("message_id"), "body_text": F.lit("b")})
    flags = mail.select("account", "message_id", (F.col("message_id") != "m0").alias("is_important"))
    feed = S.notify_feed(mail, flags).collect()
    assert sorted((r["account"], r["message_id"], r["sent_at"].minute) for r in feed) == [
        ("a", "m1", 0), ("a", "m12", 12), ("a", "m18", 18), ("a", "m6", 6), ("b", "m1", 0),
    ]
    assert {r["line"] for r in feed if r["message_id"] == "m6"} == {"From: s | Subject: m6 | Summary: b"}
