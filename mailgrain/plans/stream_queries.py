"""Queries: the streaming forms, each over all files there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgrain.plans import oracle_parts as O
from mailgrain.plans import views as V
from mailgrain.plans.registry import iso, joined, query
from mailgrain.plans.store_queries import ACTION_STATE
from mailgrain.session import shared_dir
from mailgrain.streaming import streams as X


def _stream(spark, sf_dir, name):
    """A table as a stream of files. A stream's path must be a folder, or a pattern as here: the
    pattern takes a table that is one file as well as one that is a folder."""
    return X.read_files(spark, f"{sf_dir}/{name}.parque[t]", V.table(spark, sf_dir, name).schema)


def _view(spark, sf_dir, sql, name):
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(text, **{name: _stream(spark, sf_dir, name)})


@query("stream_dedup", f"WITH {O.MAIL} SELECT DISTINCT sha256(body_text) AS content_hash FROM mail")
def stream_dedup(spark, sf_dir):
    mail = _view(spark, sf_dir, V.MAIL_SQL, "documents")
    timed = mail.withColumn("date_received", F.timestamp_seconds("epoch_s"))
    return X.run_append(X.first_contents(timed, "date_received", "800 days"), shared_dir(spark, "dedup"))


@query(
    "stream_new_contents",
    f"""WITH {O.MAIL}, m AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 'the same' ELSE body_text END AS body FROM mail)
      SELECT sha256(body) AS content_hash, min(struct_pack(s := seq, a := account, m := message_id)).m AS message_id
      FROM m GROUP BY 1""",
)
def stream_new_contents(spark, sf_dir):
    """Every content once, with the message that brought it, checked against all that was stored before."""
    mail = _view(spark, sf_dir, V.MAIL_SQL, "documents").withColumn("ingest_seq", F.col("seq"))
    mail = mail.withColumn("body_text", F.when(F.col("seq") % 3 == 0, "the same").otherwise(F.col("body_text")))
    path = shared_dir(spark, "contents")
    X.run_new_contents(mail, path)
    return X.new_contents(spark, path).select("content_hash", "message_id")


@query(
    "stream_closed_hours",
    f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n FROM events GROUP BY 1)
      SELECT strftime(hour_start, {O.ISO}) AS hour_start, n FROM h
      WHERE hour_start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 6 HOUR""",
)
def stream_closed_hours(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = X.run_append(X.closed_hours(events, "ts", "6 hours"), shared_dir(spark, "closed"))
    return closed.select(iso("hour_start").alias("hour_start"), "n")


@query(
    "stream_sender_stats",
    f"""WITH s AS ({V.SAVES_SQL}) SELECT sender AS sender_email, split_part(sender, '@', 2) AS sender_domain,
      count(*) AS total_emails, strftime(arg_max(ts, ingest_seq), {O.ISO}) AS last,
      strftime(min(ts), {O.ISO}) AS first FROM s GROUP BY 1, 2""",
)
def stream_sender_stats(spark, sf_dir):
    saves = _view(spark, sf_dir, V.SAVES_SQL, "events")
    time = F.col("ts").cast("timestamp")
    saves = saves.withColumns({"date_received": time, "ingest_time": time})
    stats = X.stream_sender_stats(saves, shared_dir(spark, "senders"))
    return stats.select(
        "sender_email", "sender_domain", "total_emails",
        iso("last_seen").alias("last"), iso("first_seen").alias("first"),
    )


@query(
    "stream_hour_counts",
    f"""WITH h AS (SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n FROM events GROUP BY 1)
      SELECT strftime(hour_start, {O.ISO}) AS hour_start, n FROM h""",
)
def stream_hour_counts(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = X.stream_hour_counts(events, "ts", shared_dir(spark, "hours"))
    return counts.select(iso("hour_start").alias("hour_start"), "n")


@query("stream_action_state", ACTION_STATE)
def stream_action_state(spark, sf_dir):
    acts = _view(spark, sf_dir, V.ACTIONS_SQL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    acts, mail = V.in_two_accounts(acts, "mail_seq"), V.in_two_accounts(V.mail(spark, sf_dir), "seq")
    state = X.stream_action_state(acts, mail, V.known_labels(spark, sf_dir), shared_dir(spark, "actions"))
    return state.select("account", "message_id", joined("labels").alias("labels"), "is_archived")
