"""Mail-shaped views over the generic test tables.

The tables hold no mail, so signals such as links, headers and bad fields are worked into whole
texts by simple rules on the row's key. The SQL here is plain enough to run on any engine: the
oracle reads the same text, and everything computed from it is up to the library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mailgrain.functions import mime
from mailgrain.session import shared_dir
from mailgrain.sources import mailstore, tables

_KEY = "lpad(lower(hex({0})), 16, '0')"

MAIL_SQL = f"""
SELECT seq, lang, source, header_kind, epoch_s, has_attachment, hour_sent,
  {_KEY.format('seq')} AS message_id,
  {_KEY.format('CASE WHEN seq % 10 < 3 THEN seq - seq % 10 ELSE seq END')} AS thread_id,
  concat('acct-', lang) AS account,
  sender, body_text,
  CASE seq % 5 WHEN 0 THEN concat('Re: ', first_line) WHEN 1 THEN 'Fw: Summer SALE limited time'
    ELSE first_line END AS subject,
  concat(lang, '@team.example.com, Bob <bob@', source, '.example.org>') AS to_header,
  CASE WHEN seq % 8 = 0 THEN '' ELSE '"Lee, Ann" <ann@x.example> ' END AS cc_header,
  CASE header_kind WHEN 'bulk' THEN 'newsletter' WHEN 'campaign' THEN 'marketing' ELSE 'personal' END AS category,
  CASE seq % 8
    WHEN 0 THEN concat('Tue, ', day, ' Mar 2024 ', lpad(hour_text, 2, '0'), ':', minute_text, ':07 +0530')
    WHEN 1 THEN concat(day, ' Nov 24 ', lpad(hour_text, 2, '0'), ':', minute_text, ' GMT')
    WHEN 2 THEN 'yesterday'
    WHEN 3 THEN '31 Feb 2024 10:00:00 +0000'
    WHEN 4 THEN concat('Mon, ', day, ' Jan 2024 ', lpad(hour_text, 2, '0'), ':', minute_text, ':59 -0800 (PST)')
    WHEN 5 THEN 'Mon, 5 Jan 2024 25:10:00 +0000'
    WHEN 6 THEN concat(day, ' September 2023 ', hour_text, ':', minute_text, ':00')
    ELSE concat('Sat, ', day, ' Dec 2023 ', lpad(hour_text, 2, '0'), ':', minute_text, ':00 +0000') END AS date_header
FROM (SELECT *, CAST(hour_sent AS STRING) AS hour_text,
    lpad(CAST(minute_sent AS STRING), 2, '0') AS minute_text, CAST(1 + seq % 28 AS STRING) AS day
  FROM (SELECT *, CAST(floor((epoch_s % 86400) / 3600) AS BIGINT) AS hour_sent,
      CAST(floor((epoch_s % 3600) / 60) AS BIGINT) AS minute_sent
    FROM (SELECT doc_id AS seq, lang, source,
        split_part(text, chr(10), 1) AS first_line,
        1704067200 + (doc_id * 26170007) % 62208000 AS epoch_s,
        doc_id % 3 = 1 AS has_attachment,
        CASE WHEN doc_id % 10 = 0 THEN 'bulk' WHEN doc_id % 7 = 0 THEN 'campaign' ELSE 'plain' END AS header_kind,
        CASE doc_id % 6
          WHEN 0 THEN concat('noreply@', source, '.example.com')
          WHEN 1 THEN concat('Ann Lee <ann@', source, '.example.org>')
          WHEN 2 THEN 'News <auto@News.example.net>'
          WHEN 3 THEN 'undisclosed'
          WHEN 4 THEN concat('bob@', lang, '.example.com')
          ELSE '"x@y" <c@z.example.com>' END AS sender,
        CASE
          WHEN doc_id % 4 = 0 THEN concat(text, ' click here to unsubscribe https://a.example/u?id=1')
          WHEN doc_id % 9 = 0 THEN concat(text, ' special offer $19.99 call 555-123-4567')
          WHEN doc_id % 11 = 0 THEN
            concat('On Monday Ann wrote:', chr(10), '> ', text, chr(10), '-- ', chr(10), 'Best regards')
          WHEN doc_id % 13 = 0 THEN
            concat(text, repeat(' http://b.example/x', 7), ' view in browser [promo] ', chr(123), 'name', chr(125))
          WHEN doc_id % 17 = 0 THEN concat(text, ' Urgent: the meeting about the loan and the mortgage')
          ELSE text END AS body_text
      FROM documents) a) b) c
"""

# The flat provider's messages are conversation turns.
FLAT_SQL = f"""
SELECT conv_id, turn, {_KEY.format('conv_id * 100 + turn')} AS message_id,
  concat(role, '@', role, '.Example.com') AS sender,
  split_part(text, chr(10), 1) AS subject, text AS body_text, role,
  1704067200 + conv_id * 3600 + turn * 60 AS epoch_s
FROM conversations
"""

SAVES_SQL = f"""
SELECT {_KEY.format('user_id')} AS message_id, user_id AS mail_seq,
  CASE WHEN user_id % 4 = 0 THEN 'undisclosed'
    ELSE concat('U <u', CAST(user_id AS STRING), '@Users.example.com>') END AS sender,
  event_type AS subject, props AS body_text, ts, event_id AS ingest_seq
FROM events
"""

ACTIONS_SQL = f"""
SELECT {_KEY.format('user_id')} AS message_id, user_id AS mail_seq, ts, event_id AS seq,
  CASE event_type
    WHEN 'view' THEN 'read'
    WHEN 'click' THEN CASE WHEN value >= 20 THEN 'star' ELSE 'unstar' END
    WHEN 'purchase' THEN CASE WHEN value >= 20 THEN 'move' ELSE 'reply' END
    WHEN 'signup' THEN 'archive'
    ELSE CASE WHEN value >= 40 THEN 'delete' ELSE 'move' END END AS action_type,
  CASE WHEN value >= 60 THEN 'nosuch' WHEN value >= 30 THEN 'asia' ELSE 'Europe' END AS action_value
FROM events
"""

UPDATES_SQL = f"""
SELECT {_KEY.format('user_id')} AS message_id,
  CASE event_type WHEN 'purchase' THEN 'important' WHEN 'click' THEN 'critical' WHEN 'view' THEN 'normal'
    WHEN 'signup' THEN 'low' ELSE 'archive' END AS priority,
  CASE WHEN value < 10 THEN 'work' ELSE 'social' END AS category,
  CASE WHEN value > 100 THEN CAST(1 AS DOUBLE) ELSE value / CAST(100 AS DOUBLE) END AS confidence,
  value >= 30 AND value < 70 AS is_uncertain, ts AS updated_at, event_id AS update_seq
FROM events
"""

FEEDBACK_SQL = f"""
SELECT {_KEY.format('doc_id')} AS message_id,
  CASE WHEN quality = 0 THEN 'low' WHEN toxic = 0 THEN 'important' ELSE 'archive' END AS priority,
  CASE WHEN toxic = 0 THEN 'work' END AS category, doc_id AS update_seq
FROM labels
"""

CALENDAR_SQL = """
SELECT o_orderkey AS id, o_custkey AS email_id, 'deadline' AS event_type,
  concat('Order ', CAST(o_orderkey AS STRING)) AS title,
  CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_orderdate END AS due_date,
  o_orderpriority AS priority, o_orderpriority = '1-URGENT' AS is_synced, o_orderstatus = 'F' AS sync_approved,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'snoozed' ELSE 'completed' END AS reminder_status,
  o_orderdate AS next_reminder_at
FROM orders
"""

REMINDERS_SQL = """
SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS id, l_orderkey AS event_id,
  l_shipdate AS reminder_time,
  CASE l_returnflag WHEN 'A' THEN 'desktop' WHEN 'N' THEN 'email' ELSE 'cli' END AS reminder_type,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate END AS sent_at,
  CASE l_returnflag WHEN 'R' THEN 'snoozed' WHEN 'A' THEN 'dismissed' ELSE 'pending' END AS user_action,
  CASE WHEN l_linestatus = 'O' THEN l_shipdate + INTERVAL '2' DAY END AS snooze_until
FROM lineitem
"""

RULES_SQL = """
SELECT 1000 + CAST(substr(source, 4) AS BIGINT) AS id, 'sender' AS condition_type,
  concat('noreply@', source, '.example.com') AS condition_value, 'auto_archive' AS action_type,
  'true' AS action_value, TRUE AS is_active, 10 AS priority FROM (SELECT DISTINCT source FROM documents) s
UNION ALL
SELECT 2000 + ascii(substr(lang, 2, 1)), 'domain', concat(lang, '.example.com'), 'set_priority',
  CASE WHEN lang = 'en' THEN 'low' ELSE 'normal' END, TRUE, 20 FROM (SELECT DISTINCT lang FROM documents) l
UNION ALL
SELECT 100000 + item_id, 'subject_contains', split_part(text, ' ', 1), 'set_priority', 'important',
  item_id % 5 <> 0, 5 + item_id % 3 FROM benchmark
UNION ALL
SELECT 50 + r_regionkey, 'category', CASE WHEN r_regionkey % 2 = 0 THEN 'newsletter' ELSE 'marketing' END,
  'label', lower(r_name), TRUE, r_regionkey FROM region
"""

FIELDS_SQL = f"""
SELECT doc_id AS seq,
  CASE WHEN doc_id % 17 = 0 THEN '../../etc/passwd' WHEN doc_id % 19 = 0 THEN ''
    WHEN doc_id % 23 = 0 THEN concat('  ', upper({_KEY.format('doc_id')}), ' ')
    ELSE {_KEY.format('doc_id')} END AS message_id,
  CASE WHEN doc_id % 29 = 0 THEN 'abc' ELSE {_KEY.format('doc_id % 97')} END AS thread_id,
  CASE doc_id % 9 WHEN 0 THEN 'INBOX' WHEN 1 THEN 'Important/Work' WHEN 2 THEN '' WHEN 3 THEN repeat('x', 101)
    WHEN 4 THEN 'Übung 1' WHEN 5 THEN 'a;b' WHEN 6 THEN ' Test-Label ' WHEN 7 THEN repeat('y', 100)
    ELSE source END AS label,
  CASE doc_id % 5 WHEN 0 THEN 'user@example.com' WHEN 1 THEN 'not_an_email'
    WHEN 2 THEN concat(' Ann@', upper(lang), '.Example.ORG ') WHEN 3 THEN concat(repeat('a', 250), '@x.com')
    ELSE concat('a.b+c@', source, '.example.co') END AS email,
  CASE doc_id % 7 WHEN 0 THEN 'report.pdf' WHEN 1 THEN '../up.txt' WHEN 2 THEN '.hidden'
    WHEN 3 THEN concat('a', chr(92), 'b') WHEN 4 THEN '' WHEN 5 THEN repeat('f', 256)
    ELSE concat(' ', source, '/x.csv ') END AS filename,
  concat(chr(7), split_part(text, chr(10), 1), chr(9)) AS subject,
  CAST(n_chars AS DOUBLE) / CAST(4000 AS DOUBLE) AS confidence,
  CASE doc_id % 6 WHEN 0 THEN ' Critical ' WHEN 1 THEN 'urgent' WHEN 2 THEN 'LOW' WHEN 3 THEN 'archive'
    WHEN 4 THEN NULL ELSE 'normal' END AS priority,
  CASE doc_id % 4 WHEN 0 THEN 'Social ' WHEN 1 THEN 'high' WHEN 2 THEN 'work' ELSE 'other' END AS category
FROM documents
"""

LIST_UNSUBSCRIBE = "<mailto:out@lists.example.com>, <https://lists.example.com/out?x=1>"


# Tables of long texts and their keys.
TEXTS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return tables.read_texts(spark, path, TEXTS[name]) if name in TEXTS else tables.read(spark, path)


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The shared SQL with each table name bound to its file, without touching the catalog."""
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        text = text.replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def _header_pairs() -> Column:
    """Raw header pairs as a provider sends them: mixed case, a repeated name."""
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    common = [
        pair("From", F.col("sender")),
        pair("Received", F.lit("first")),
        pair("To", F.col("to_header")),
        pair("Subject", F.col("subject")),
        pair("Date", F.col("date_header")),
        pair("RECEIVED", F.lit("last")),
    ]
    bulk = [pair("List-Unsubscribe", F.lit(LIST_UNSUBSCRIBE)), pair("Precedence", F.lit("Bulk"))]
    campaign = [pair("X-Campaign-Id", F.lit("c1")), pair("Auto-Submitted", F.lit("auto-generated"))]
    plain = [pair("Cc", F.col("cc_header"))]
    kind = F.col("header_kind")
    return (
        F.when(kind == "bulk", F.array(*common, *bulk))
        .when(kind == "campaign", F.array(*common, *campaign))
        .otherwise(F.array(*common, *plain))
    )


def _headers() -> Column:
    """The same pairs as the map a parsed message holds."""
    names = {"from": "sender", "to": "to_header", "subject": "subject", "date": "date_header"}
    common = F.create_map(
        *[x for name, column in names.items() for x in (F.lit(name), F.col(column))], F.lit("received"), F.lit("last")
    )
    extra = lambda *pairs: F.create_map(*[F.lit(x) for x in pairs])
    kind = F.col("header_kind")
    return F.map_concat(
        common,
        F.when(kind == "bulk", extra("list-unsubscribe", LIST_UNSUBSCRIBE, "precedence", "Bulk"))
        .when(kind == "campaign", extra("x-campaign-id", "c1", "auto-submitted", "auto-generated"))
        .otherwise(F.create_map(F.lit("cc"), F.col("cc_header"))),
    )


def mail_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MAIL_SQL, "documents")


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed mail: a projection of one scan, no join."""
    base = mail_base(spark, sf_dir).withColumn("headers", _headers())
    starred = F.when(F.col("seq") % 5 == 0, F.array(F.lit("STARRED"))).otherwise(F.array().cast("array<string>"))
    return base.select(
        F.lit("gmail").alias("provider"),
        "account",
        "message_id",
        "thread_id",
        "sender",
        mime.recipients(F.col("headers")).alias("recipients"),
        "subject",
        F.timestamp_seconds("epoch_s").alias("date_received"),
        "body_text",
        "headers",
        F.concat(F.array(F.lit("INBOX"), F.lit("UNREAD")), starred).alias("labels"),
        "has_attachment",
        "seq",
        "category",
    )


def gmail_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested provider messages in four shapes, some with bytes that are no UTF-8."""
    base = mail_base(spark, sf_dir)
    raw = F.encode("body_text", "UTF-8")
    damaged = F.when(F.col("seq") % 50 == 4, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    data = lambda b: F.translate(F.base64(b), "+/", "-_")
    text = data(damaged)
    html = data(F.encode(F.concat(F.lit("<p>"), F.col("body_text"), F.lit("</p>")), "UTF-8"))
    none = F.lit(None).cast("string")

    def part(kind: str, content: Column, filename: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("mimeType"), filename.alias("filename"), F.struct(content.alias("data")).alias("body")
        )

    shape = F.col("seq") % 4
    body = F.when(shape == 0, text).when(shape == 3, F.lit(""))
    parts = (
        F.when(
            shape == 1,
            F.array(part("text/plain", text), part("text/html", html), part("application/pdf", none, F.lit("a.pdf"))),
        )
        .when(
            shape == 2,
            F.array(part("text/html", html, F.lit("")), part("text/plain", none), part("text/plain", text)),
        )
        .when(shape == 3, F.array(part("text/plain", text), part("text/html", none)))
    )
    return base.select(
        F.col("message_id").alias("id"),
        F.col("thread_id").alias("threadId"),
        (F.col("epoch_s") * 1000).cast("string").alias("internalDate"),
        F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            _header_pairs().alias("headers"),
            F.struct(body.alias("data")).alias("body"),
            parts.alias("parts"),
        ).alias("payload"),
    )


def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as flat provider messages."""
    base = view(spark, sf_dir, FLAT_SQL, "conversations")
    origin = F.when(F.col("role") == "assistant", F.create_map(F.lit("x-pm-origin"), F.lit("internal")))
    return base.select(
        F.col("message_id").alias("id"),
        F.col("sender").alias("from"),
        F.array(F.lit("me@flat.example.com")).alias("to"),
        "subject",
        F.col("body_text").alias("body"),
        F.col("epoch_s").alias("time"),
        F.coalesce(origin, F.create_map(F.lit("x-pm-content-encryption"), F.lit("end-to-end"))).alias("headers"),
    )


def _timed(rows: DataFrame, *columns: str) -> DataFrame:
    """Zone-less times of the tables as UTC instants."""
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def stored_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow columns of all mail, written by date and read back from there."""
    path = shared_dir(spark, "mail")
    narrow = mail(spark, sf_dir).select("provider", "account", "message_id", "sender", "date_received")
    mailstore.write_mail(narrow, path, unit="month")
    return mailstore.read_mail(spark, path, StructType(list(narrow.schema.fields)).add("received_on", "date"))


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, SAVES_SQL, "events")
    return _timed(rows, "ts").withColumns({"date_received": F.col("ts"), "ingest_time": F.col("ts")}).drop("ts")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(view(spark, sf_dir, ACTIONS_SQL, "events"), "ts")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(view(spark, sf_dir, UPDATES_SQL, "events"), "updated_at")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, FEEDBACK_SQL, "labels")
    return rows.withColumn("given_at", F.timestamp_seconds(F.lit(1704067200) + F.col("update_seq")))


def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(view(spark, sf_dir, CALENDAR_SQL, "orders"), "due_date", "next_reminder_at")


def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, REMINDERS_SQL, "lineitem")
    return _timed(rows, "reminder_time", "sent_at", "snooze_until")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RULES_SQL, "documents", "benchmark", "region")


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is known to one of two accounts."""
    account = F.concat(F.lit("acct-"), F.col("r_regionkey") % 2)
    return table(spark, sf_dir, "region").select(account.alias("account"), F.col("r_name").alias("name"))


def in_two_accounts(rows: DataFrame, number: str) -> DataFrame:
    """Rows dealt to two accounts that share their message ids, by a number of each row."""
    shared = F.expr(_KEY.format(f"{number} - {number} % 2"))
    return rows.withColumns({"account": F.concat(F.lit("acct-"), F.col(number) % 2), "message_id": shared})


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FIELDS_SQL, "documents")
