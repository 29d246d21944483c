"""Streams over several files against the batch forms, with repeats, late rows and replays."""

from datetime import datetime, timedelta
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import actions as A
from mailgrain.operators import senders as S
from mailgrain.operators import store as T
from mailgrain.plans import views as V
from mailgrain.streaming import parts as P
from mailgrain.streaming import streams as X

SF_DIR = "/root/testdata/sf0.001"


def split_files(rows, path, order, files=4):
    """Rows as several files, in the given order of arrival."""
    ordered = rows.withColumn("_part", F.ntile(files).over(order))
    for i in range(1, files + 1):
        ordered.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return rows.schema


def by(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def same(one, two):
    return one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_sender_stats(spark, tmp_path):
    saves = V.saves(spark, SF_DIR)
    schema = split_files(saves, str(tmp_path / "in"), by(F.col("ingest_seq").desc()))
    stream = X.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    got = X.stream_sender_stats(stream, str(tmp_path / "out"))
    assert len(list((tmp_path / "out" / "parts").glob("batch=[0-9]*"))) == 4
    assert same(got, S.sender_stats(saves))


def test_action_state_with_replay(spark, tmp_path):
    mail, acts = V.in_two_accounts(V.mail(spark, SF_DIR), "seq"), V.in_two_accounts(V.actions(spark, SF_DIR), "mail_seq")
    known = V.known_labels(spark, SF_DIR)
    schema = split_files(acts, str(tmp_path / "in"), by(F.col("seq").desc()))
    stream = X.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    got = X.stream_action_state(stream, mail, known, str(tmp_path / "out"))
    want = A.action_state(mail, acts, known)
    assert same(got, want)
    # The same rows once more under another batch id change nothing.
    ops = A.last_ops(A.label_ops(acts, known))
    ops.write.parquet(str(tmp_path / "out" / "parts" / "batch=99"))
    again = A.state_of(A.last_ops(A.initial_ops(mail, ["account", "message_id"]).unionByName(X.read_parts(spark, str(tmp_path / "out")))))
    assert same(again, want)


def test_dedup_over_batches(spark, tmp_path):
    mail = V.mail(spark, SF_DIR).select("message_id", "date_received", "body_text", "seq")
    # A third of all rows hold one text.
    mail = mail.withColumn("body_text", F.when(F.col("seq") % 3 == 0, "same").otherwise(F.col("body_text")))
    schema = split_files(mail, str(tmp_path / "in"), by("date_received"))
    stream = X.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    got = X.run_append(X.first_contents(stream, "date_received", "800 days"), str(tmp_path / "out"))
    log = mail.withColumn("ingest_seq", F.col("seq"))
    want = T.is_duplicate(T.hashed(log)).filter("not is_duplicate").select("content_hash")
    assert same(got, want)


def test_hour_counts_hold_every_hour(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(start + timedelta(minutes=m),) for m in (0, 59, 61, 130, 185, 3)]
    mail = spark.createDataFrame(rows, "ts timestamp")
    schema = split_files(mail, str(tmp_path / "in"), by("ts"), files=3)
    stream = X.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    got = X.stream_hour_counts(stream, "ts", str(tmp_path / "out")).collect()
    assert sorted((r["hour_start"].hour, r["n"]) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 1)]


def test_empty_folders_give_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    saves = V.saves(spark, SF_DIR)
    stream = X.read_files(spark, str(tmp_path / "in"), saves.schema)
    assert X.stream_sender_stats(stream, str(tmp_path / "a")).count() == 0
    assert X.stream_hour_counts(stream, "date_received", str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("sorting", ["asc", "desc"])
def test_parts_merge_in_any_order(spark, sorting):
    saves = V.saves(spark, SF_DIR)
    halves = [S.sender_parts(saves.filter(F.col("ingest_seq") % 2 == k)) for k in (0, 1)]
    first, second = halves if sorting == "asc" else halves[::-1]
    assert same(S.merge_sender_parts(first.unionByName(second)), S.sender_stats(saves))


def folders_of(path):
    return len([p for p in (path / "parts").glob("batch=[0-9]*")]) + len([p for p in (path / "merged").glob("level=*/part=*")])


def test_a_thousand_parts_leave_few_folders(spark, tmp_path):
    """Parts of three rows each: the same sums before, during and after, and a bounded number of folders."""
    path, merge = str(tmp_path), X.merged_hours
    day = datetime(2025, 1, 1)
    part = lambda i: spark.createDataFrame([(day + timedelta(hours=i % 5), i)], "hour_start timestamp, n long")
    P.write_part(part(0).limit(0), P.part_path(path, 0, -1))
    want, most, fan = {}, 0, 4
    for i in range(70):
        P.write_part(part(i), P.part_path(path, 0, i))
        want[i % 5] = want.get(i % 5, 0) + i
        P.compact(spark, path, merge, i, fan=fan)
        most = max(most, folders_of(tmp_path))
        if i % 7 == 0 or i > 62:
            got = {r["hour_start"].hour: r["n"] for r in merge(X.read_parts(spark, path, fan)).collect()}
            assert got == want
    assert most <= 2 * fan * 4 and len(P.live_parts(spark, path, fan=fan)) <= 1 + 4 * (fan - 1)


def test_a_lost_merge_and_a_repeated_batch_change_nothing(spark, tmp_path, monkeypatch):
    path, merge = str(tmp_path), X.merged_hours
    part = lambda n: spark.createDataFrame([(datetime(2025, 1, 1), n)], "hour_start timestamp, n long")
    total = lambda: merge(X.read_parts(spark, path, 2)).head()["n"]
    P.write_part(part(0).limit(0), P.part_path(path, 0, -1))
    for i in range(2):
        P.write_part(part(10**i), P.part_path(path, 0, i))
    with monkeypatch.context() as m:
        m.setattr(P.folders, "switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            P.compact(spark, path, merge, 1, fan=2)
    assert total() == 11  # merged, but not switched
    for _ in range(2):  # the batch comes again, and once more after the switch
        P.write_part(part(10), P.part_path(path, 0, 1))
        P.compact(spark, path, merge, 1, fan=2)
        assert total() == 11
    for i in (2, 3, 4):
        P.write_part(part(10**i), P.part_path(path, 0, i))
        P.compact(spark, path, merge, i, fan=2)
        assert total() == int("1" * (i + 1))
    assert sorted(p.name for p in (tmp_path / "merged").glob("level=*/*")) == ["part=0", "part=0", "part=1"]


def test_streams_merge_their_parts(spark, tmp_path):
    saves = V.saves(spark, SF_DIR)
    schema = split_files(saves, str(tmp_path / "in"), by("ingest_seq"), files=9)
    stream = X.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    X.run_parts(stream, str(tmp_path / "out"), S.sender_parts, merge=S.merged_parts, fan=2)
    assert len(P.live_parts(spark, str(tmp_path / "out"), fan=2)) == 2  # one of eight, one of one
    assert same(S.merge_sender_parts(X.read_parts(spark, str(tmp_path / "out"), 2)), S.sender_stats(saves))


def test_contents_are_checked_against_all_before(spark, tmp_path, monkeypatch):
    """Repeats after any time are found, and only the folders of a batch's hashes are read."""
    rows = [(f"m{i}", i, None if i == 5 else f"text {i % 7}" if i < 60 else f"late {i}") for i in range(66)] + [("z", 99, "text 0")]
    mail = spark.createDataFrame(rows, "message_id string, ingest_seq long, body_text string")
    schema = split_files(mail, str(tmp_path / "in"), by("ingest_seq"), files=5)
    stream, out = X.read_files(spark, str(tmp_path / "in"), schema, files_per_batch=1), str(tmp_path / "out")
    read, asked = P.folders.read, []
    monkeypatch.setattr(P.folders, "read", lambda s, schema, paths: asked.append((schema.names, paths)) or read(s, schema, paths))
    X.run_new_contents(stream, out, fan=2)
    got = {(r["content_hash"], r["message_id"]) for r in X.new_contents(spark, out, 2).collect()}
    log = {}
    for name, seq, text in sorted(rows, key=lambda r: r[1]):
        log.setdefault(sha256((text or "").encode()).hexdigest(), name)
    assert got == set(log.items())
    for names, paths in asked:
        if names == ["content_hash"]:
            assert all("/prefix=" in p for p in paths)


def test_hours_close_once(spark, tmp_path):
    """Late rows within the delay count, rows behind it do not, and no hour comes twice."""
    hour = lambda h, m=0: datetime(2025, 1, 1) + timedelta(hours=h, minutes=m)
    batches = [[hour(0), hour(0, 59), hour(3)], [hour(1), hour(2, 30), hour(5)], [hour(0, 30), hour(9)], [hour(8), hour(8, 1), hour(20)]]
    source = str(tmp_path / "in")
    closed, seen = [], []
    for times in batches:
        spark.createDataFrame([(t,) for t in times], "ts timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = X.read_files(spark, source, spark.createDataFrame([], "ts timestamp").schema, files_per_batch=1)
        rows = X.run_append(X.closed_hours(stream, "ts", "2 hours"), str(tmp_path / "out")).collect()
        closed.append(sorted((r["hour_start"].hour, r["n"]) for r in rows))
        seen += times
    assert closed == [[(0, 2)], [(0, 2), (1, 1), (2, 1)], [(0, 2), (1, 1), (2, 1), (3, 1), (5, 1)], [(0, 2), (1, 1), (2, 1), (3, 1), (5, 1), (8, 2), (9, 1)]]


def test_an_export_is_taken_in_by_new_files_only(spark, tmp_path):
    from mailgrain.sources import exports as E

    export, messages = tmp_path / "export", V.gmail_export(spark, SF_DIR)
    parse = lambda lines: E.parse_gmail(E.sound(lines), "main")
    some = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    messages.filter(some).write.json(str(export))
    once = X.take_in(E.stream_gmail(spark, str(export)), parse, str(tmp_path / "mail")).count()
    files = set(export.glob("*.json"))
    for old in files:
        old.write_text('{"id": "read again"}\n')  # a second reading would show
    messages.filter(~some).write.mode("append").json(str(export))
    (export / "damaged.json").write_text('{"id": "cut off\n')
    mail = X.take_in(E.stream_gmail(spark, str(export)), parse, str(tmp_path / "mail"))
    want = E.parse_gmail(messages, "main")
    assert 0 < once < mail.count() == want.count()
    columns = ["message_id", "thread_id", "sender", "subject", "body_text", "date_received", "seq"]
    assert same(mail.select(columns), want.select(columns))
