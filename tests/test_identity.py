"""Messages of several accounts with one id, saves with one arrival number, header names in any case."""

import base64

from pyspark.sql import functions as F

from mailgrain.functions import mime
from mailgrain.operators import actions as A
from mailgrain.operators import classify as C
from mailgrain.operators import models as M
from mailgrain.operators import report as R
from mailgrain.operators import senders as S
from mailgrain.operators import store as T

SAVE = "account string, message_id string, body_text string, ingest_seq long, date_received timestamp"


def saves(spark, rows):
    schema = SAVE.replace("timestamp", "long")
    return spark.createDataFrame(rows, schema).withColumn("date_received", F.timestamp_seconds("date_received"))


def test_last_save_with_equal_numbers(spark):
    rows = [("x", "A", "a5", 5, 1), ("x", "A", "a9", 9, 1), ("x", "B", "b9", 9, 1), ("x", "B", "b12", 12, 1), ("y", "A", "other", 9, 1),
            ("x", "C", "early", 3, 1), ("x", "C", "late", 3, 2)]
    got = {(r["account"], r["message_id"]): r["body_text"] for r in T.latest_saves(saves(spark, rows)).collect()}
    assert got == {("x", "A"): "a9", ("x", "B"): "b12", ("y", "A"): "other", ("x", "C"): "late"}


def test_duplicates_are_of_other_messages(spark):
    rows = [("x", "A", "t", 1, 1), ("x", "A", "t", 2, 1), ("x", "B", "t", 2, 1), ("x", "A", "t", 3, 1), ("y", "A", "t", 4, 1),
            ("x", "D", "u", 7, 1), ("x", "C", "u", 7, 1), ("x", "E", None, 1, 1), ("x", "F", None, 2, 1), ("x", "G", "own", 1, 1), ("x", "G", "own", 2, 1)]
    hashes = T.hashed(saves(spark, rows))
    got = {(r["account"], r["message_id"], r["ingest_seq"]): r["is_duplicate"] for r in T.is_duplicate(hashes).collect()}
    assert got == {
        ("x", "A", 1): False, ("x", "A", 2): False, ("x", "B", 2): True, ("x", "A", 3): True, ("y", "A", 4): True,
        ("x", "D", 7): True, ("x", "C", 7): False, ("x", "E", 1): False, ("x", "F", 2): True, ("x", "G", 1): False, ("x", "G", 2): False,
    }
    first = saves(spark, rows).withColumn("content_hash", T.content_hash(F.col("body_text")))
    kept = {(r["account"], r["message_id"], r["ingest_seq"]) for r in T.deduplicated(first).collect() if r["body_text"] == "u"}
    assert kept == {("x", "C", 7)}


def test_threads_and_flags_stay_in_their_account(spark):
    rows = [("x", "1", "t", "s", "", "b", 1), ("y", "1", "t", "s", "", "urgent", 2), ("y", "2", "t", "s", "", "b", 3), ("z", "1", "t", "s", "", "b", 4)]
    mail = spark.createDataFrame(rows, "account string, message_id string, thread_id string, sender string, subject string, body_text string, seq long")
    flags = C.flag_importance(mail, spark.createDataFrame([("w",)], "sender string"))
    got = {(r["account"], r["message_id"]): (r["in_chain"], r["is_important"]) for r in flags.collect()}
    assert got == {("x", "1"): (False, False), ("y", "1"): (True, True), ("y", "2"): (True, True), ("z", "1"): (False, False)}
    feed = S.notify_feed(mail.withColumn("date_received", F.timestamp_seconds(F.col("seq") * 1000)), flags)
    assert {r["account"] for r in feed.collect()} == {"y"}


def test_learned_weights_in_force(spark):
    rows = [("x", "1", "a webinar", {"X-PM-Origin": "1"}), ("y", "1", "nothing", {"x-pm-origin": "1"}), ("y", "2", "abc123", {})]
    mail = spark.createDataFrame(rows, "account string, message_id string, body_text string, headers map<string,string>")
    table = [("keywords", "webinar", 0.75), ("patterns", "[a-c]+[0-9]{3}", 0.5), ("headers", "x-pm-origin", 0.25)]
    weights = spark.createDataFrame(table, "category string, pattern string, weight double")
    got = {(r["account"], r["message_id"]): (r["hits"], r["ratio_score"], r["mean_score"]) for r in C.classify_learned(mail, weights).collect()}
    assert got == {("x", "1"): (2, 1.0, 0.75), ("y", "1"): (1, 1.0, 0.25), ("y", "2"): (1, 1.0, 0.5)}


def test_header_names_in_any_case(spark):
    rows = [("m", "a@b.c", "s", "hello", {"Precedence": "Bulk", "List-Unsubscribe": "<mailto:out@x>", "DATE": "Mon, 1 Jan 2024 07:00:00 +0000"}, 1)]
    mail = spark.createDataFrame(rows, "message_id string, sender string, subject string, body_text string, headers map<string,string>, seq long")
    scored = C.classify_additive(mail)
    row = scored.head()
    assert row["score"] == 1.0 and row["indicators"] == ["list-unsubscribe", "precedence: bulk"]
    assert [r["target"] for r in C.unsubscribe_targets(scored).collect()] == ["mailto:out@x"]
    assert R.analysed(mail).head()["hour"] == 7


def test_lenient_decoding_keeps_genuine_replacement_characters(one):
    raw = "a\ufffdb\ue0001c".encode() + b"\xff\xfe" + "d\ufffd".encode()
    data = base64.urlsafe_b64encode(raw).decode()
    assert one(mime.decode_lenient, data) == "a\ufffdb\ue0001cd\ufffd"


def test_ties_of_top_lists(spark):
    rows = [("b", 1), ("a", 1), ("c", 1)]
    counted = spark.createDataFrame(rows, "sender string, seq long")
    assert [r["sender"] for r in R.top_senders(counted, 2).collect()] == ["a", "b"]


def test_actions_stay_in_their_account(spark):
    mail = spark.createDataFrame([("x", "m1", "s", ["UNREAD"]), ("y", "m1", "t", ["UNREAD"])], "account string, message_id string, sender string, labels array<string>")
    rows = [("x", "m1", "read", None, 1), ("x", "m1", "move", "WORK", 2), ("y", "m1", "move", "work", 3), ("y", "m1", "star", None, 4)]
    acts = spark.createDataFrame(rows, "account string, message_id string, action_type string, action_value string, seq long")
    acts = acts.withColumn("ts", F.timestamp_seconds("seq"))
    known = spark.createDataFrame([("x", "Work"), ("y", "Home")], "account string, name string")
    state = {r["account"]: r["labels"] for r in A.action_state(mail, acts, known).collect()}
    assert state == {"x": ["Work"], "y": ["STARRED", "UNREAD"]}
    everywhere = {r["account"]: r["labels"] for r in A.action_state(mail, acts, known.select("name")).collect()}
    assert everywhere == {"x": ["Work"], "y": ["STARRED", "UNREAD", "Work"]}
    assert {(r["account"], r["action_type"]): r["n"] for r in A.action_counts(acts).collect()} == {(a, k): 1 for a, _, k, _, _ in rows}
    seen = mail.withColumns({"date_received": F.lit(None).cast("timestamp"), "is_bot": F.lit(False), "user_priority": F.lit(None).cast("string")})
    behaviour = {r["sender_email"]: r["read_count"] for r in S.sender_behaviour(seen, acts).collect()}
    assert behaviour == {"s": 1, "t": 0}


def test_labels_and_raw_messages_stay_in_their_account(spark):
    rows = [("x", "1", "s@x.de", "a", "b", {"from": "s"}), ("y", "1", "s@x.de", "a", "b", {"from": "s"})]
    mail = spark.createDataFrame(rows, "account string, message_id string, sender string, subject string, body_text string, headers map<string,string>")
    mail = mail.withColumns({"recipients": F.array(F.lit("r")), "has_attachment": F.lit(False), "date_received": F.timestamp_seconds(F.lit(0))})
    told = spark.createDataFrame([("y", "1", "low", "work")], "account string, message_id string, priority string, category string")
    samples = M.build_training_set(mail, told)
    assert {r["account"]: r["label_priority"] for r in samples.collect()} == {"x": None, "y": "low"}
    assert [r["account"] for r in M.validated_training(samples).collect()] == ["y"]
    raw = spark.createDataFrame([("x", "1", False), ("z", "1", False), ("y", "1", True)], "account string, message_id string, is_deleted boolean")
    assert [r["account"] for r in T.live_raw_messages(raw, mail).collect()] == ["x"]
