from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import actions as A
from mailgrain.operators import calendar as K
from mailgrain.operators import models as M
from mailgrain.operators import quality as Q
from mailgrain.operators import senders as S
from mailgrain.operators import store as T
from mailgrain.sources import mailstore


def day(n):
    return datetime(2025, 1, n)


@pytest.fixture
def store(spark):
    rows = [(f"m{i}", day(i)) for i in range(1, 6)]
    return T.with_store_defaults(spark.createDataFrame(rows, "message_id string, date_received timestamp"))


UPDATE = "message_id string, priority string, category string, confidence double, is_uncertain boolean, " \
    "updated_at timestamp, update_seq long"
FEEDBACK = "message_id string, priority string, category string, given_at timestamp, update_seq long"


def test_feedback_loop(spark, store):
    updates = spark.createDataFrame(
        [("m1", "low", "work", 0.5, True, day(9), 1), ("m1", "normal", "work", 0.9, False, day(10), 2),
         ("m2", "low", None, 0.4, True, day(9), 3), ("m3", "low", None, 0.4, True, day(9), 4)],
        UPDATE,
    )
    classified = T.apply_classification(store, updates)
    assert [r["message_id"] for r in T.unprocessed_emails(classified).collect()] == ["m5", "m4"]
    assert [r["message_id"] for r in T.emails_for_review(classified).collect()] == ["m3", "m2"]
    first = classified.filter("message_id = 'm1'").head()
    assert first["classification_priority"] == "normal" and not first["needs_review"] and first["is_processed"]
    told = T.apply_feedback(
        classified.withColumn("user_category", F.lit("old")),
        spark.createDataFrame([("m2", "critical", None, day(11), 1)], FEEDBACK),
    )
    assert [r["message_id"] for r in T.emails_for_review(told).collect()] == ["m3"]
    row = {r["message_id"]: r for r in told.collect()}
    assert row["m2"]["user_category"] is None and row["m3"]["user_category"] == "old"
    archived = classified.withColumn("is_archived", F.col("message_id") == "m3")
    assert [r["message_id"] for r in T.emails_for_review(archived).collect()] == ["m2"]


def test_write_and_read_back(spark, tmp_path, store):
    path = str(tmp_path / "mail")
    mailstore.write_mail(store, path)
    back = mailstore.read_mail(spark, path, store.schema).select(*store.columns)
    assert back.exceptAll(store).count() == 0 and back.count() == 5
    assert "received_on=2025-01-03" in [p.name for p in (tmp_path / "mail").iterdir()]


def test_hashes_and_duplicates(spark):
    rows = [("a", "x", 1), ("b", "x", 2), ("a", "y", 3), ("c", "x", 4), ("d", "", 5)]
    hashes = T.hashed(spark.createDataFrame(rows, "message_id string, body_text string, ingest_seq long"))
    kept = {r["message_id"]: r["ingest_seq"] for r in T.store_hashes(hashes).collect()}
    assert kept == {"a": 1, "b": 2, "c": 4, "d": 5}
    flags = {r["ingest_seq"]: r["is_duplicate"] for r in T.is_duplicate(hashes).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_orphans(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1,), (3,), (3,), (4,)], "mail long")
    row = T.orphan_check({"c": (child, "mail")}, parents, "id").head()
    assert (row["child_rows"], row["orphan_rows"], row["missing_parents"]) == (4, 3, 2)
    assert T.cascade(child, parents, "mail", "id").count() == 1


EVENT = "id long, due_date timestamp, is_synced boolean, sync_approved boolean, reminder_status string, next_reminder_at timestamp"
REMINDER = "id long, event_id long, reminder_time timestamp, user_action string, sent_at timestamp, snooze_until timestamp"


def test_reminders(spark):
    events = spark.createDataFrame(
        [(1, day(9), False, False, "pending", day(2)), (2, None, False, False, "snoozed", day(1)),
         (3, day(8), False, False, "sent", day(1)), (4, day(7), False, True, "pending", None),
         (5, day(7), True, False, "pending", day(5))],
        EVENT,
    )
    reminders = spark.createDataFrame(
        [(10, 1, day(3), "snoozed", day(3), None), (11, 1, day(2), "snoozed", day(2), day(6)), (12, 3, day(1), "x", None, None)],
        REMINDER,
    )
    due = K.due_reminders(events, reminders, F.lit(day(3))).collect()
    assert [(r["event_id"], r["reminder_id"]) for r in due] == [(2, None), (1, 11), (1, 10)]
    assert [r["id"] for r in K.pending_events(events).collect()] == [2, 3, 1]
    assert [r["id"] for r in K.reminders_for_event(reminders, events.filter("id = 1")).collect()] == [11, 10]
    back = {r["id"]: r["returns_at"] for r in K.snooze(reminders).collect()}
    assert back == {10: datetime(2025, 1, 3, 4), 11: day(6)}


def test_schedule(spark):
    events = spark.createDataFrame([(1, day(9)), (2, None)], "id long, due_date timestamp")
    rows = K.reminder_schedule(events, F.lit(datetime(2025, 1, 7))).collect()
    assert [(r["hours_before"], r["reminder_time"]) for r in rows] == [
        (168, day(2)), (48, day(7)), (24, day(8)), (3, datetime(2025, 1, 8, 21)),
    ]
    assert {r["next_reminder_at"] for r in rows} == {day(7)}
    late = K.reminder_schedule(events, F.lit(day(10)), [5]).head()
    assert late["next_reminder_at"] is None and late["reminder_time"] == datetime(2025, 1, 8, 19)


def test_append_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id long")
    K.append(rows, str(tmp_path / "e"), "b1")
    K.append(rows, str(tmp_path / "e"), "b1")
    K.append(rows, str(tmp_path / "e"), "b2")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_sender_stats(spark):
    rows = [("a@b>", day(5), 1, day(1)), ("a@b>", day(3), 2, day(2)), ("x", day(1), 3, day(3))]
    saves = spark.createDataFrame(rows, "sender string, date_received timestamp, ingest_seq long, ingest_time timestamp")
    row = S.sender_stats(saves).filter("sender_email = 'a@b>'").head()
    assert (row["total_emails"], row["last_seen"], row["first_seen"], row["sender_domain"]) == (2, day(3), day(1), "b>")


def test_behaviour(spark):
    rows = [("1", "s", day(1), True, "critical"), ("2", "s", day(2), False, None), ("3", "t", day(3), True, None)]
    mail = spark.createDataFrame(rows, "message_id string, sender string, date_received timestamp, is_bot boolean, user_priority string")
    acts = spark.createDataFrame([("1", "read"), ("1", "read"), ("2", "star")], "message_id string, action_type string")
    out = {r["sender_email"]: r for r in S.sender_behaviour(mail, acts).collect()}
    assert out["s"]["read_count"] == 2 and out["s"]["avg_user_priority"] == 5.0 and not out["s"]["is_automated"]
    assert out["t"]["is_automated"] and out["t"]["read_count"] == 0 and out["t"]["avg_user_priority"] is None


def test_feed_cooldown(spark):
    minutes = lambda m: datetime(2025, 1, 1, 0, m)
    rows = [("a", str(i), "s", "t", "b  b", minutes(m), i) for i, m in enumerate([0, 3, 6, 8])]
    mail = spark.createDataFrame(rows, "account string, message_id string, sender string, subject string, body_text string, date_received timestamp, seq long")
    flags = spark.createDataFrame([("0", False), ("1", True), ("2", True), ("3", True)], "message_id string, is_important boolean")
    feed = S.notify_feed(mail, flags).orderBy("sent_at").collect()
    assert [r["message_id"] for r in feed] == ["1", "3"]
    assert feed[0]["line"] == "From: s | Subject: t | Summary: b b"


def test_metrics(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "a")] * 2 + [("c", "a")]
    out = {r["class"]: r for r in M.model_metrics(spark.createDataFrame(pairs, "label string, predicted string")).collect()}
    assert (out["a"]["precision"], out["a"]["recall"], out["a"]["support"]) == (3 / 6, 3 / 4, 4)
    assert out["a"]["f1"] == 6 / 10 and out["b"]["recall"] == 0 and out["c"]["precision"] is None
    assert out["a"]["accuracy"] == 3 / 7 and out["a"]["samples"] == 7


def test_validated_samples(spark):
    rows = [("a", {"f": 1.0}, "low", None, True, day(1)), ("b", {}, "low", "work", True, day(2)), ("c", {}, None, None, False, day(3))]
    samples = spark.createDataFrame(rows, "message_id string, features map<string,double>, label_priority string, label_category string, is_validated boolean, created_at timestamp")
    assert [r["message_id"] for r in M.validated_training(samples).collect()] == ["b", "a"]
    assert M.validated_training(samples, 0).count() == 2 and M.validated_training(samples, 1).count() == 1


ACT = "message_id string, action_type string, action_value string, ts timestamp, seq long"


def test_action_fold(spark):
    mail = spark.createDataFrame([("1", ["INBOX", "UNREAD"]), ("2", ["STARRED"])], "message_id string, labels array<string>")
    acts = spark.createDataFrame(
        [("1", "read", None, day(1), 1), ("1", "move", "WORK", day(2), 2), ("1", "move", "nosuch", day(3), 3),
         ("1", "star", None, day(5), 4), ("1", "unstar", None, day(4), 5), ("2", "unstar", None, day(1), 6),
         ("2", "archive", None, day(1), 7), ("2", "delete", None, day(1), 8), ("2", "reply", None, day(1), 9)],
        ACT,
    )
    known = spark.createDataFrame([("Work",), ("Home",)], "name string")
    out = {r["message_id"]: (r["labels"], r["is_archived"]) for r in A.action_state(mail, acts, known).collect()}
    assert out == {"1": (["INBOX", "STARRED", "Work"], False), "2": (["ARCHIVED", "TRASH"], True)}
    ops = A.label_ops(acts, known)
    again = A.last_ops(A.last_ops(ops).unionByName(A.last_ops(ops)))
    assert again.exceptAll(A.last_ops(ops)).count() == 0


FIELDS = "message_id string, thread_id string, label string, email string, filename string, subject string, " \
    "confidence double, priority string, category string"
GOOD = dict(
    message_id="18a1b2c3d4e5f6a7", thread_id="18A1B2C3D4E5F6A7", label="Important/Work", email="user@example.com",
    filename="a.pdf", subject="s", confidence=0.5, priority="normal", category="work",
)


@pytest.mark.parametrize(
    "field, value, broken, clean",
    [
        ("message_id", " 18a1b2c3d4e5f6a7\n", False, "18a1b2c3d4e5f6a7"),
        ("message_id", "18a1b2c3d4e5f6a", True, None),
        ("message_id", "../../etc/passwd", True, None),
        ("message_id", "'; DROP TABLE emails;", True, None),
        ("message_id", None, True, None),
        ("label", "INBOX", False, "INBOX"),
        ("label", "Übung ²", False, "Übung ²"),
        ("label", "", True, None),
        ("label", "x" * 100, False, "x" * 100),
        ("label", "x" * 101, True, None),
        ("label", "a;b", True, None),
        ("email", "not_an_email", True, None),
        ("email", " User@Example.COM ", False, "user@example.com"),
        ("email", "a" * 242 + "@example.com", False, "a" * 242 + "@example.com"),
        ("email", "a" * 243 + "@example.com", True, None),
        ("filename", "../a\\b", True, "_".join(["..", "a", "b"])),
        ("filename", "a/b\\c", False, "a_b_c"),
        ("filename", ".hidden", True, None),
        ("filename", "", True, None),
        ("filename", "x" * 256, True, None),
        ("confidence", 0.0, False, 0.0),
        ("confidence", 1.0, False, 1.0),
        ("confidence", 1.5, True, 1.5),
        ("confidence", -0.1, True, -0.1),
        ("confidence", float("nan"), True, None),
        ("priority", " Critical ", False, "critical"),
        ("priority", "high", True, "high"),
        ("category", "Social", False, "social"),
        ("category", "urgent", True, "urgent"),
        ("subject", "\x07a\tb\nc\x1f ", False, "ab\nc"),
        ("subject", "x" * 1001, False, "x" * 1000),
    ],
)
def test_fields(spark, field, value, broken, clean):
    row = Q.quarantine(spark.createDataFrame([tuple({**GOOD, field: value}.values())], FIELDS)).head()
    assert row["violations"] == ([field] if broken else [])
    if clean is not None:
        assert row[field] == clean


def test_split_and_summary(spark):
    rows = [tuple(GOOD.values()), tuple({**GOOD, "email": "x", "priority": "y"}.values())]
    marked = Q.quarantine(spark.createDataFrame(rows, FIELDS))
    assert Q.clean_rows(marked).count() == 1 and Q.rejected_rows(marked).count() == 1
    assert {r["rule"]: r["rejected"] for r in Q.dq_summary(marked).collect()} == {"email": 1, "priority": 1}
    some = Q.quarantine(spark.createDataFrame([("x",)], "email string"))
    assert some.columns == ["email", "violations"]


def test_masks(one):
    from mailgrain.functions import privacy as P

    token = "A1" * 18
    assert one(P.mask_data, f"to user@example.com {token}") == "to u***@example.com [TOKEN]"
    assert one(P.mask_data, "x" * 31) == "x" * 31
    assert one(P.mask_data, "x" * 32) == "[TOKEN]"
    assert one(P.mask_data, "é" + "x" * 32) == "é" + "x" * 32
    assert one(lambda c: P.mask_data(c, addresses=False), "a@b.com") == "a@b.com"
    assert one(P.mask_log, "ab+/" * 8 + "a") == "[TOKEN]"
    assert one(P.mask_log, "Password: hunter2 KEY='abc' token none") == "Password=*** KEY=***' token none"
    assert one(P.mask_log, None) is None
    assert one(P.redact_body, "Text: a body: b") == "Text: a body: [REDACTED]"
    assert one(P.redact_body, "x message:y") == "x message: [REDACTED]"
    assert one(P.redact_body, "plain") == "plain"
