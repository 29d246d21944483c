"""Batches merged into stored mail against a full rewrite: folders touched, moves, repeats, lost writers."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailgrain.operators import merge as G
from mailgrain.operators import store as T
from mailgrain.sources import folders

SCHEMA = "provider string, account string, message_id string, body_text string, date_received timestamp, ingest_seq long"
START = datetime(2025, 1, 1, 12)


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def mails(rng, n, days, seq):
    return [
        ("gmail", rng.choice(["a", "b", None]), f"m{rng.randrange(40)}", f"text {seq}.{i}", START + timedelta(days=rng.choice(days)), seq * 1000 + i)
        for i in range(n)
    ]


def same(one, two):
    return one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_batches_equal_the_full_rewrite(spark, tmp_path):
    rng, path, log = random.Random(3), str(tmp_path), []
    for seq, days in enumerate([range(6), (2, 3), (9,), (0, 5), range(10)]):
        part = mails(rng, 30, days, seq)
        log += part
        G.merge_mail(batch(spark, part), path)
        stored = G.read_merged(spark, path, batch(spark, []).schema)
        assert same(stored, T.latest_saves(batch(spark, log)))
    assert G.merge_mail(batch(spark, log[:50]), path) == []  # late and repeated saves lose
    G.merge_mail(batch(spark, []), path)
    assert same(G.read_merged(spark, path, batch(spark, []).schema), T.latest_saves(batch(spark, log)))
    assert G.sweep(spark, path) > 0 and G.sweep(spark, path) == 0
    assert same(G.read_merged(spark, path, batch(spark, []).schema), T.latest_saves(batch(spark, log)))


def test_only_touched_folders_are_written(spark, tmp_path):
    path, schema = str(tmp_path), batch(spark, []).schema
    day = lambda d: START + timedelta(days=d)
    first = [("gmail", "a", f"m{d}", "old", day(d), 1) for d in range(5)]
    G.merge_mail(batch(spark, first), path)
    before = folders.newest(spark, path)
    # m1 moves from day 1 to day 3; an unknown message without a date comes in.
    touched = G.merge_mail(batch(spark, [("gmail", "a", "m1", "new", day(3), 2), ("gmail", "b", "m1", "x", None, 2)]), path)
    assert touched == ["received_on=2025-01-02", "received_on=2025-01-04", "received_on=__HIVE_DEFAULT_PARTITION__"]
    after = folders.newest(spark, path)
    moved = {k for k in {*before.numbers, *after.numbers} if before.numbers.get(k) != after.numbers.get(k) and k.startswith("received_on")}
    assert moved == set(touched) and "received_on=2025-01-02" not in after.numbers
    got = {(r["account"], r["message_id"]): (r["body_text"], r["date_received"]) for r in G.read_merged(spark, path, schema).collect()}
    assert got == {("a", f"m{d}"): ("old", day(d)) for d in (0, 2, 3, 4)} | {("a", "m1"): ("new", day(3)), ("b", "m1"): ("x", None)}
    some = G.read_merged(spark, path, schema, since="2025-01-04", until="2025-01-04")
    assert {r["message_id"] for r in some.collect()} == {"m1", "m3"}
    files = some.inputFiles()
    assert files and all("received_on=2025-01-04" in f for f in files)


def test_the_plan_reads_the_folders_of_the_batch_only(spark, tmp_path, monkeypatch):
    path, read, asked = str(tmp_path), folders.read, []
    monkeypatch.setattr(folders, "read", lambda s, schema, paths: asked.extend(paths) or read(s, schema, paths))
    G.merge_mail(batch(spark, [("gmail", "a", f"m{d}", "t", START + timedelta(days=d), 1) for d in range(40)]), path)
    asked.clear()
    G.merge_mail(batch(spark, [("gmail", "a", "m7", "again", START + timedelta(days=7), 2)]), path)
    rows = {p.rsplit("/", 1)[1] for p in asked if "/rows/" in p}
    assert rows == {"received_on=2025-01-08"} and len({p for p in asked if "/places/" in p}) == 1


def test_a_writer_lost_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path), batch(spark, []).schema
    one, two = (("gmail", "a", "m1", f"v{s}", START + timedelta(days=s), s) for s in (1, 2))
    G.merge_mail(batch(spark, [one]), path)
    with monkeypatch.context() as m:
        m.setattr(folders, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        try:
            G.merge_mail(batch(spark, [two]), path)
        except RuntimeError:
            pass
    assert [r["body_text"] for r in G.read_merged(spark, path, schema).collect()] == ["v1"]
    # A manifest cut off while it is written is passed over as well.
    (tmp_path / "live" / "version=2").mkdir()
    assert [r["body_text"] for r in G.read_merged(spark, path, schema).collect()] == ["v1"]
    G.merge_mail(batch(spark, [two]), path)
    assert [r["body_text"] for r in G.read_merged(spark, path, schema).collect()] == ["v2"]


def test_an_empty_store(spark, tmp_path):
    schema = batch(spark, []).schema
    assert G.read_merged(spark, str(tmp_path / "none"), schema).count() == 0
    assert G.merge_mail(batch(spark, []).filter(F.lit(True)), str(tmp_path / "none")) == []
