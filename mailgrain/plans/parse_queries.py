"""Queries: reading exports and single-message features."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgrain.functions import features as X
from mailgrain.functions import mime
from mailgrain.operators import classify as C
from mailgrain.plans import oracle_parts as O
from mailgrain.plans import views as V
from mailgrain.plans.registry import iso, joined, query
from mailgrain.session import shared_dir
from mailgrain.sources import exports as E
from mailgrain.sources import mailstore
from mailgrain.streaming import streams

_BAD = "seq % 50 = 4 AND seq % 4 IN (0, 1, 3)"
_STRICT = f"CASE WHEN {_BAD} THEN NULL WHEN seq % 4 = 2 THEN '' ELSE body_text END"
_LENIENT = "CASE WHEN seq % 4 = 3 THEN '' ELSE body_text END"
_HTML = "CASE WHEN seq % 4 IN (1, 2) THEN concat('<p>', body_text, '</p>') WHEN seq % 4 = 3 THEN '' END"
_TO = "concat(lang, '@team.example.com|Bob <bob@', source, '.example.org>')"
_CC = "CASE WHEN header_kind <> 'plain' THEN '' WHEN seq % 8 = 0 THEN '|' ELSE '|\"Lee|Ann\" <ann@x.example>' END"
_RECIPIENTS = f"concat({_TO}, {_CC})"
_ATTACHED = "seq % 4 IN (1, 2)"
_PARSED = f"{O.MAIL}, parsed AS (SELECT *, {_STRICT} AS strict, {_RECIPIENTS} AS recipients FROM mail)"


def _exported(spark, messages, name):
    """An export as a provider's tool leaves it: a folder of JSON lines, one of them damaged."""
    path = shared_dir(spark, name)
    messages.write.json(path)
    spark.range(1).select(F.lit('{"id": "cut off').alias("value")).write.mode("append").text(path)
    return path


def _gmail(spark, sf_dir, lenient=False):
    return E.parse_gmail(V.gmail_export(spark, sf_dir), "main", lenient)


@query(
    "scan_mail_export",
    f"""WITH {_PARSED} SELECT message_id, thread_id, sender, recipients, subject, strict AS body_text,
      strftime(date_received, {O.ISO}) AS received, {O.ratio_score("coalesce(strict, '')")} > 0.5 AS is_bot
      FROM parsed""",
)
def scan_mail_export(spark, sf_dir):
    raw = E.sound(E.read_gmail(spark, _exported(spark, V.gmail_export(spark, sf_dir), "gmail")))
    scanned = C.classify_ratio(E.parse_gmail(raw, "main"))
    return scanned.select(
        "message_id", "thread_id", "sender", joined("recipients").alias("recipients"), "subject", "body_text",
        iso("date_received").alias("received"), "is_bot",
    )


@query(
    "scan_mail_window",
    f"""WITH {O.MAIL} SELECT message_id, sender, strftime(date_received, {O.ISO}) AS received FROM mail
      WHERE date_received >= {O.WINDOW[12]} AND date_received <= TIMESTAMP '2025-06-30'""",
)
def scan_mail_window(spark, sf_dir):
    as_of = F.lit("2025-06-30 00:00:00").cast("timestamp")
    found = E.window_scan(V.stored_mail(spark, sf_dir), as_of, months_back=12)
    return found.select("message_id", "sender", iso("date_received").alias("received"))


@query(
    "scan_new_mail",
    f"""WITH {_PARSED} SELECT message_id, thread_id, sender, recipients, subject, strict AS body_text,
      strftime(date_received, {O.ISO}) AS received FROM parsed""",
)
def scan_new_mail(spark, sf_dir):
    """An export taken in as it grows: the second run reads only the files that the first has not seen."""
    messages, path = V.gmail_export(spark, sf_dir), shared_dir(spark, "inbox")
    first, folder = F.pmod(F.xxhash64("id"), F.lit(3)) > 0, _exported(spark, messages.limit(0), "growing")
    for some in (first, ~first):
        messages.filter(some).write.mode("append").json(folder)
        mail = streams.take_in(E.stream_gmail(spark, folder), lambda lines: E.parse_gmail(E.sound(lines), "main"), path)
    return mail.select(
        "message_id", "thread_id", "sender", joined("recipients").alias("recipients"), "subject", "body_text",
        iso("date_received").alias("received"),
    )


@query(
    "scan_flat_export",
    f"""WITH {O.FLAT} SELECT message_id, sender, 'me@flat.example.com' AS recipients, subject, body_text,
      strftime(date_received, {O.ISO}) AS received FROM flat""",
)
def scan_flat_export(spark, sf_dir):
    raw = E.sound(E.read_flat(spark, _exported(spark, V.flat_export(spark, sf_dir), "flat")))
    mail = E.parse_flat(raw, "flat")
    return mail.select(
        "message_id", "sender", joined("recipients").alias("recipients"), "subject", "body_text",
        iso("date_received").alias("received"),
    )


@query(
    "union_accounts",
    f"""WITH {_PARSED}, {O.FLAT}
      SELECT 'gmail' AS provider, 'main' AS account, message_id, thread_id, sender, strict AS body_text,
        {_ATTACHED} AS has_attachment, strftime(date_received, {O.ISO}) AS received FROM parsed
      UNION ALL SELECT 'protonmail', 'flat', message_id, NULL, sender, body_text, FALSE,
        strftime(date_received, {O.ISO}) FROM flat""",
)
def union_accounts(spark, sf_dir):
    both = E.union_accounts(_gmail(spark, sf_dir), E.parse_flat(V.flat_export(spark, sf_dir), "flat"))
    return both.select(
        "provider", "account", "message_id", "thread_id", "sender", "body_text",
        F.coalesce("has_attachment", F.lit(False)).alias("has_attachment"), iso("date_received").alias("received"),
    )


@query(
    "header_map",
    f"""WITH {O.MAIL} SELECT message_id, array_to_string(list_sort(string_split(header_names, ',')), '|') AS names,
      'last' AS received, CASE WHEN header_kind = 'bulk' THEN 'Bulk' END AS precedence, date_header AS date
      FROM mail""",
)
def header_map(spark, sf_dir):
    raw = V.gmail_export(spark, sf_dir)
    parsed = raw.select("id", mime.header_map(F.col("payload.headers")).alias("h"))
    return parsed.select(
        F.col("id").alias("message_id"),
        joined(F.array_sort(F.map_keys("h"))).alias("names"),
        F.col("h")["received"].alias("received"),
        F.col("h")["precedence"].alias("precedence"),
        F.col("h")["date"].alias("date"),
    )


@query("recipients", f"WITH {O.MAIL} SELECT message_id, {_RECIPIENTS} AS recipients FROM mail")
def recipients(spark, sf_dir):
    return _gmail(spark, sf_dir).select("message_id", joined("recipients").alias("recipients"))


@query("body_text", f"WITH {O.MAIL} SELECT message_id, {_STRICT} AS body_text FROM mail")
def body_text(spark, sf_dir):
    return _gmail(spark, sf_dir).select("message_id", "body_text")


@query("body_text_lenient", f"WITH {O.MAIL} SELECT message_id, {_LENIENT} AS body_text FROM mail")
def body_text_lenient(spark, sf_dir):
    return _gmail(spark, sf_dir, lenient=True).select("message_id", "body_text")


@query("body_html", f"WITH {O.MAIL} SELECT message_id, {_HTML} AS body_html FROM mail")
def body_html(spark, sf_dir):
    return _gmail(spark, sf_dir).select("message_id", "body_html")


@query(
    "decode_base64url",
    f"""WITH {O.MAIL} SELECT message_id, CASE WHEN seq % 4 >= 2 THEN '' ELSE body_text END AS lenient,
      NOT (seq % 50 = 4 AND seq % 4 < 2) AS sound FROM mail""",
)
def decode_base64url(spark, sf_dir):
    own = F.col("payload.body.data")
    first = F.get(F.filter("payload.parts", lambda p: p["mimeType"] == "text/plain"), 0)["body"]["data"]
    data = V.gmail_export(spark, sf_dir).select(F.col("id").alias("message_id"), F.coalesce(own, first).alias("data"))
    return data.select(
        "message_id",
        mime.decode_lenient(F.col("data")).alias("lenient"),
        mime.decode_strict(F.col("data")).isNotNull().alias("sound"),
    )


@query("message_time", f"WITH {O.MAIL} SELECT message_id, strftime(date_received, {O.ISO}) AS received FROM mail")
def message_time(spark, sf_dir):
    raw = V.gmail_export(spark, sf_dir)
    return raw.select(F.col("id").alias("message_id"), iso(mime.message_time(F.col("internalDate"))).alias("received"))


@query("has_attachment", f"WITH {O.MAIL} SELECT message_id, {_ATTACHED} AS has_attachment FROM mail")
def has_attachment(spark, sf_dir):
    return _gmail(spark, sf_dir).select("message_id", "has_attachment")


@query(
    "decode_stored_mail",
    f"""WITH {O.MAIL}
      SELECT message_id, CASE WHEN seq % 11 = 0 THEN '' ELSE {_RECIPIENTS} END AS recipients,
        sender AS header_from, CASE WHEN seq % 3 = 0 THEN NULL ELSE 'INBOX|UNREAD' END AS labels,
        strftime(date_received, {O.ISO}) AS received,
        CASE WHEN seq % 2 = 0 THEN strftime(date_received, {O.ISO}) END AS feedback,
        has_attachment AS is_processed, FALSE AS needs_review
      FROM mail""",
)
def decode_stored_mail(spark, sf_dir):
    mail = V.mail(spark, sf_dir)
    seq = F.col("seq")
    dumped = mail.select(
        "message_id",
        F.when(seq % 11 != 0, F.to_json("recipients")).alias("recipients"),
        F.to_json("headers").alias("headers"),
        F.when(seq % 3 != 0, F.to_json(F.slice("labels", 1, 2))).alias("labels"),
        F.lit(None).cast("string").alias("gmail_labels"),
        F.date_format("date_received", "yyyy-MM-dd'T'HH:mm:ss").alias("date_received"),
        F.lit(None).cast("string").alias("date_processed"),
        F.when(seq % 2 == 0, F.date_format("date_received", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("").alias(
            "feedback_date"
        ),
        F.lit(None).cast("bigint").alias("is_uncertain"),
        F.col("has_attachment").cast("bigint").alias("is_processed"),
        F.lit(0).cast("bigint").alias("is_archived"),
        F.lit(0).cast("bigint").alias("needs_review"),
    )
    rows = mailstore.decode_stored_mail(dumped)
    return rows.select(
        "message_id",
        joined("recipients").alias("recipients"),
        F.col("headers")["from"].alias("header_from"),
        joined("labels").alias("labels"),
        iso("date_received").alias("received"),
        iso("feedback_date").alias("feedback"),
        "is_processed",
        "needs_review",
    )


def _feature(name, column, sql):
    """A query of one feature per message."""

    @query(name, f"WITH {O.MAIL} SELECT message_id, {sql} AS value FROM mail")
    def run(spark, sf_dir):
        return V.mail(spark, sf_dir).select("message_id", column().alias("value"))

    return run


_feature("sender_domain_learn", lambda: X.sender_domain_learn(F.col("sender")), O.DOMAIN_LEARN)
_feature("sender_domain_report", lambda: X.sender_domain_report(F.col("sender")), "domain_report")
_feature("sender_domain_store", lambda: X.sender_domain_store(F.col("sender")), "split_part(sender, '@', 2)")
_feature("sender_name", lambda: X.sender_name(F.col("sender")), O.NAME)
_feature("length_bucket", lambda: X.length_bucket(F.length("body_text")), O.LENGTH)
_feature("spacing_bucket", lambda: X.spacing_bucket(X.mean_line_length(F.col("body_text"))), O.SPACING)
_feature("link_bucket", lambda: X.link_bucket(X.link_count(F.col("body_text"))), O.LINKS)
_feature("url_count", lambda: X.url_count(F.col("body_text")), O.count_of("body_text", "https?://"))
_feature("hour_received", lambda: X.hour_received(F.col("date_received")), "hour(date_received)")
_feature("hour_header", lambda: X.hour_header(F.col("headers")["date"]), "hour_written")
_feature("subject_markers", lambda: joined(X.subject_markers(F.col("subject"))), O.labels(O.SUBJECT_MARKERS))
_feature("content_markers", lambda: joined(X.content_markers(F.col("body_text"))), O.labels(O.CONTENT_MARKERS))
_feature("reply_markers", lambda: joined(X.reply_markers(F.col("body_text"))), O.labels(O.REPLY_MARKERS))
_feature("signature_marker", lambda: X.signature_marker(F.col("body_text")), O.SIGNATURE)
_feature("content_hash", lambda: X.content_hash(F.col("body_text")), "sha256(body_text)")


@query(
    "mail_preview",
    f"""WITH {O.MAIL}, s AS (SELECT *, {O.SQUEEZED} AS squeezed FROM mail)
      SELECT message_id, {O.PREVIEW.format('squeezed', 100)} AS summary,
        {O.PREVIEW.format('subject', 50)} AS subject FROM s""",
)
def mail_preview(spark, sf_dir):
    body, subject = F.col("body_text"), F.col("subject")
    return V.mail(spark, sf_dir).select(
        "message_id", X.mail_preview(body).alias("summary"), X.subject_preview(subject).alias("subject")
    )


@query(
    "subject_words",
    f"""WITH {O.MAIL}, w AS (SELECT message_id, unnest(regexp_split_to_array(trim(low_subject), '\\s+')) AS word FROM mail)
      SELECT message_id, word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY ALL""",
)
def subject_words(spark, sf_dir):
    words = V.mail(spark, sf_dir).select("message_id", F.explode(X.subject_words(F.col("subject"))).alias("word"))
    return words.groupBy("message_id", "word").agg(F.count(F.lit(1)).alias("n"))
