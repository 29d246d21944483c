import base64
import json

from pyspark.sql import functions as F

from mailgrain.sources import exports as E
from mailgrain.sources import mailstore


def b64(data):
    data = data.encode() if isinstance(data, str) else data
    return base64.urlsafe_b64encode(data).decode()


def message(ident, headers, payload, when="1704067200123"):
    pairs = [{"name": n, "value": v} for n, v in headers]
    return {"id": ident, "threadId": "t", "internalDate": when, "payload": {"headers": pairs, **payload}}


def write(path, lines):
    path.mkdir()
    (path / "a.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def parsed(spark, tmp_path, payload, headers=(("From", "a@b.com"),), lenient=False):
    raw = E.read_gmail(spark, write(tmp_path / f"m{len(list(tmp_path.iterdir()))}", [message("m", headers, payload)]))
    return E.parse_gmail(raw, "main", lenient).head()


def part(mime, data=None, **more):
    return {"mimeType": mime, "body": {} if data is None else {"data": data}, **more}


def test_headers_and_recipients(spark, tmp_path):
    row = parsed(
        spark,
        tmp_path,
        {"body": {"data": b64("hi")}},
        [("From", "A <a@b.com>"), ("RECEIVED", "1"), ("received", "2"), ("To", ' x@y.z , "Lee, Ann" <l@z.z>'), ("Cc", "")],
    )
    assert row["headers"]["received"] == "2" and row["sender"] == "A <a@b.com>"
    assert row["recipients"] == ["x@y.z", '"Lee', 'Ann" <l@z.z>', ""]
    assert row["subject"] == "" and row["date_received"].microsecond == 123000


def test_no_headers(spark, tmp_path):
    row = parsed(spark, tmp_path, {}, [])
    assert row["headers"] == {} and row["recipients"] == [] and row["sender"] == "" and row["body_text"] == ""


def test_two_body_rules(spark, tmp_path):
    two = {"parts": [part("text/plain"), part("text/plain", b64("second")), part("text/html", b64("<b>"))]}
    assert parsed(spark, tmp_path, two)["body_text"] == ""
    assert parsed(spark, tmp_path, two, lenient=True)["body_text"] == "second"
    assert parsed(spark, tmp_path, two)["body_html"] == "<b>"
    empty = {"body": {"data": ""}, "parts": [part("text/plain", b64("plain"))]}
    assert parsed(spark, tmp_path, empty)["body_text"] == "plain"
    assert parsed(spark, tmp_path, empty, lenient=True)["body_text"] == ""
    assert parsed(spark, tmp_path, empty)["body_html"] is None
    nested = {"parts": [part("multipart/alternative", parts=[part("text/plain", b64("deep"))])]}
    assert parsed(spark, tmp_path, nested)["body_text"] == ""


def test_bad_text(spark, tmp_path):
    bad = {"body": {"data": b64(b"ab\xffc")}}
    assert parsed(spark, tmp_path, bad)["body_text"] is None
    assert parsed(spark, tmp_path, bad, lenient=True)["body_text"] == "abc"
    tricky = {"body": {"data": b64("é😀?>~")}}
    assert parsed(spark, tmp_path, tricky)["body_text"] == "é😀?>~"


def test_attachment(spark, tmp_path):
    assert not parsed(spark, tmp_path, {"parts": [part("text/plain")]})["has_attachment"]
    assert parsed(spark, tmp_path, {"parts": [part("text/plain", filename="")]})["has_attachment"]


def test_damaged_line_is_kept(spark, tmp_path):
    path = write(tmp_path / "x", [message("m", [], {}), "{broken"])
    raw = E.read_gmail(spark, path)
    assert raw.count() == 2
    assert [r["_damaged"] for r in raw.cache().filter(F.col("_damaged").isNotNull()).collect()] == ["{broken"]


def test_unreadable_rows_fail_alone(spark, tmp_path):
    lines = [message("a", [], {}, "soon"), message("b", [], {"body": {"data": b64(b"\xff")}}), message("c", [], {})]
    mail = E.parse_gmail(E.read_gmail(spark, write(tmp_path / "x", lines)), "main")
    assert [r["message_id"] for r in E.unreadable(mail).orderBy("message_id").collect()] == ["a", "b"]


def test_recent_gmail_order(spark, tmp_path):
    lines = [message(i, [], {}, when) for i, when in [("b", "900"), ("a", "900"), ("c", "1000"), ("d", "99")]]
    raw = E.read_gmail(spark, write(tmp_path / "x", lines))
    assert [r["message_id"] for r in E.recent_gmail(raw, "main", 3).collect()] == ["c", "a", "b"]


def test_flat_and_union(spark, tmp_path):
    flat = {"id": "p", "from": "x@y.z", "to": ["a", "b"], "subject": "s", "body": "b", "time": 60, "headers": {"h": "1"}}
    first = E.parse_gmail(E.read_gmail(spark, write(tmp_path / "g", [message("m", [], {})])), "one")
    second = E.parse_flat(E.read_flat(spark, write(tmp_path / "p", [flat])), "two")
    rows = {r["account"]: r for r in E.union_accounts(first, second).collect()}
    assert rows["two"]["recipients"] == ["a", "b"] and rows["two"]["provider"] == "protonmail"
    assert rows["two"]["date_received"].minute == 1 and rows["two"]["body_html"] is None
    assert rows["one"]["message_id"] == "m"


def test_window(spark):
    rows = [("a", "2025-01-01"), ("b", "2025-01-31"), ("c", "2025-02-01"), ("d", "2025-03-02")]
    mail = spark.createDataFrame(rows, "message_id string, d string").withColumn("date_received", F.to_timestamp("d"))
    as_of = F.lit("2025-03-02").cast("timestamp")
    assert [r["message_id"] for r in E.window_scan(mail, as_of, 1, 10).collect()] == ["d", "c", "b"]
    assert [r["message_id"] for r in E.window_scan(mail, as_of, 1, 2).collect()] == ["d", "c"]


def test_repeated_json_key(spark):
    from pyspark.sql import types as T

    from mailgrain import schemas

    row = {f.name: None for f in schemas.STORED_MAIL.fields} | {"headers": '{"a":"1","a":"2"}', "recipients": ""}
    stored = spark.createDataFrame([tuple(row.values())], T.StructType(schemas.STORED_MAIL.fields))
    mail = mailstore.decode_stored_mail(stored).head()
    assert mail["headers"] == {"a": "2"} and mail["recipients"] == [] and mail["is_archived"] is False


def test_stored_event(spark):
    row = spark.createDataFrame(
        [(1, "2025-01-01T10:00:00", "", 0, 1)],
        "id long, start_datetime string, end_datetime string, is_synced long, sync_approved long",
    )
    full = row.withColumns({c: F.lit(None).cast("string") for c in ("due_date", "next_reminder_at", "created_at", "updated_at")})
    event = mailstore.decode_stored_event(full).head()
    assert event["start_datetime"].hour == 10 and event["end_datetime"] is None
    assert event["is_synced"] is False and event["sync_approved"] is True
