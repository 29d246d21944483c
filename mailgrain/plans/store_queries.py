"""Queries: the store, calendar, rules, senders, models, actions, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgrain.functions import privacy as P
from mailgrain.functions.features import sender_domain_learn
from mailgrain.operators import actions as A
from mailgrain.operators import calendar as K
from mailgrain.operators import classify as C
from mailgrain.operators import learn as L
from mailgrain.operators import merge as G
from mailgrain.operators import models as M
from mailgrain.operators import quality as Q
from mailgrain.operators import senders as S
from mailgrain.operators import store as T
from mailgrain.operators.rules import apply_rules
from mailgrain.plans import oracle_parts as O
from mailgrain.plans import views as V
from mailgrain.plans.registry import iso, joined, query
from mailgrain.plans.report_queries import IMPORTANT, important
from mailgrain.session import shared_dir, stored
from mailgrain.sources import mailstore

_SAVED = ["account", "message_id", "sender", "subject", "body_text", "date_received", "ingest_seq"]
_SHARED_ID = V._KEY.format("seq - seq % 2")


def _save_batches(spark, sf_dir):
    """First saves of all mail and later re-saves of some. Two accounts share message ids, and two saves in a row
    share an arrival number."""
    two = F.concat(F.lit("acct-"), F.col("seq") % 2).alias("account")
    shared = F.expr(_SHARED_ID).alias("message_id")
    rest = ("sender", "subject", "body_text")
    first = V.mail(spark, sf_dir).select(two, shared, *rest, "date_received", F.expr("seq div 2 * 2").alias("ingest_seq"))
    saves = V.saves(spark, sf_dir).withColumn("seq", F.col("mail_seq"))
    again = saves.select(two, shared, *rest, "date_received", F.expr("ingest_seq * 2 + 1").alias("ingest_seq"))
    return first, again


def _save_log(spark, sf_dir):
    first, again = _save_batches(spark, sf_dir)
    return first.unionByName(again)


_SAVE_LOG = f"""{O.MAIL}, log AS (
  SELECT concat('acct-', seq % 2) AS account, {_SHARED_ID} AS message_id, sender, subject, body_text, date_received,
    seq // 2 * 2 AS ingest_seq FROM mail
  UNION ALL SELECT concat('acct-', seq % 2), {_SHARED_ID}, sender, subject, body_text, ts, ingest_seq * 2 + 1
    FROM (SELECT *, mail_seq AS seq FROM ({V.SAVES_SQL}) s0) s)"""


_LAST_SAVES = f"""WITH {_SAVE_LOG} SELECT account, message_id, sender, subject, body_text, ingest_seq,
  strftime(date_received, {O.ISO}) AS received FROM log
  QUALIFY row_number() OVER (PARTITION BY account, message_id ORDER BY ingest_seq DESC, date_received DESC) = 1"""


def _as_saved(mail):
    return mail.select(
        "account", "message_id", "sender", "subject", "body_text", "ingest_seq", iso("date_received").alias("received")
    )


@query("store_emails", _LAST_SAVES)
def store_emails(spark, sf_dir):
    path = shared_dir(spark, "emails")
    log = _save_log(spark, sf_dir)
    mailstore.write_mail(T.latest_saves(log), path, unit="month")
    return _as_saved(mailstore.read_mail(spark, path, log.schema))


@query("merge_emails", _LAST_SAVES)
def merge_emails(spark, sf_dir):
    """The first saves, then the re-saves as a batch that moves some messages to other dates."""
    path = shared_dir(spark, "emails")
    first, again = _save_batches(spark, sf_dir)
    for batch in (first, again):
        G.merge_mail(batch, path, unit="month", prefix_digits=1)
    return _as_saved(G.read_merged(spark, path, first.schema))


def _mails_asked_for(spark, sf_dir, *columns):
    return V.view(spark, sf_dir, V.FEEDBACK_SQL, "labels").select(*columns)


@query(
    "email_by_id",
    f"""WITH {O.MAIL} SELECT seq AS id, message_id, sender, subject, body_text FROM mail
      WHERE seq IN (SELECT doc_id FROM labels)""",
)
def email_by_id(spark, sf_dir):
    mail = V.mail(spark, sf_dir).withColumnRenamed("seq", "id")
    asked = _mails_asked_for(spark, sf_dir, F.col("update_seq").alias("id"))
    return T.by_ids(mail, asked, "id").select("id", "message_id", "sender", "subject", "body_text")


@query(
    "email_by_message_id",
    f"""WITH {O.MAIL} SELECT message_id, sender, subject, body_text FROM mail
      WHERE message_id IN (SELECT message_id FROM ({V.SAVES_SQL}) s)""",
)
def email_by_message_id(spark, sf_dir):
    found = T.by_ids(V.mail(spark, sf_dir), V.saves(spark, sf_dir), "message_id")
    return found.select("message_id", "sender", "subject", "body_text")


def _store(spark, sf_dir):
    """Stored mail after the classification updates and the user's feedback."""
    new = T.with_store_defaults(V.mail(spark, sf_dir))
    new = new.withColumn("is_archived", F.col("seq") % 7 == 0)
    classified = T.apply_classification(new, V.updates(spark, sf_dir))
    return T.apply_feedback(classified, V.feedback(spark, sf_dir))


_STORE = f"""{O.MAIL}, {O.UPDATES}, store AS (
  SELECT m.*, u.priority AS classification_priority, u.category AS classification_category,
    u.confidence AS confidence_score, coalesce(u.is_uncertain, FALSE) AS is_uncertain,
    u.message_id IS NOT NULL AS is_processed, u.updated_at AS date_processed, seq % 7 = 0 AS is_archived,
    f.priority AS user_priority, f.category AS user_category,
    CASE WHEN f.message_id IS NULL THEN NULL ELSE make_timestamp((1704067200 + f.update_seq) * 1000000) END
      AS feedback_date,
    coalesce(u.is_uncertain, FALSE) AND f.message_id IS NULL AS needs_review
  FROM mail m LEFT JOIN latest u USING (message_id) LEFT JOIN feedback f ON f.message_id = m.message_id)"""


@query(
    "unprocessed_emails",
    f"""WITH {_STORE} SELECT message_id, sender, subject, strftime(date_received, {O.ISO}) AS received FROM store
      WHERE NOT is_processed ORDER BY date_received DESC, account, message_id LIMIT 100""",
)
def unprocessed_emails(spark, sf_dir):
    waiting = T.unprocessed_emails(_store(spark, sf_dir), size=100)
    return waiting.select("message_id", "sender", "subject", iso("date_received").alias("received"))


@query(
    "emails_for_review",
    f"""WITH {_STORE} SELECT message_id, sender, confidence_score FROM store
      WHERE needs_review AND NOT is_archived ORDER BY date_received DESC, account, message_id LIMIT 50""",
)
def emails_for_review(spark, sf_dir):
    return T.emails_for_review(_store(spark, sf_dir), size=50).select("message_id", "sender", "confidence_score")


@query(
    "apply_classification",
    f"""WITH {_STORE} SELECT message_id, classification_priority, classification_category, confidence_score,
      is_uncertain, is_uncertain AS needs_review, is_processed, strftime(date_processed, {O.ISO}) AS processed
      FROM store""",
)
def apply_classification(spark, sf_dir):
    new = T.with_store_defaults(V.mail(spark, sf_dir))
    return T.apply_classification(new, V.updates(spark, sf_dir)).select(
        "message_id", "classification_priority", "classification_category", "confidence_score",
        "is_uncertain", "needs_review", "is_processed", iso("date_processed").alias("processed"),
    )


@query(
    "apply_feedback",
    f"""WITH {_STORE} SELECT message_id, user_priority, user_category, needs_review,
      strftime(feedback_date, {O.ISO}) AS given FROM store""",
)
def apply_feedback(spark, sf_dir):
    return _store(spark, sf_dir).select(
        "message_id", "user_priority", "user_category", "needs_review", iso("feedback_date").alias("given")
    )


def _hashes(spark, sf_dir):
    """Stored once: bodies are read and hashed in one pass, whatever is done with the hashes."""
    return stored(T.hashed(_save_log(spark, sf_dir)), "hashes")


@query(
    "store_hashes",
    f"""WITH {_SAVE_LOG} SELECT account, message_id, ingest_seq, sha256(body_text) AS content_hash FROM log
      QUALIFY row_number() OVER (PARTITION BY account, message_id ORDER BY ingest_seq, sha256(body_text)) = 1""",
)
def store_hashes(spark, sf_dir):
    return T.store_hashes(_hashes(spark, sf_dir))


@query(
    "is_duplicate",
    f"""WITH {_SAVE_LOG}, places AS (SELECT account, message_id, ingest_seq, sha256(body_text) AS content_hash FROM log)
      SELECT *, EXISTS (SELECT 1 FROM places b WHERE b.content_hash = a.content_hash
        AND (b.account <> a.account OR b.message_id <> a.message_id)
        AND (b.ingest_seq, b.account, b.message_id) < (a.ingest_seq, a.account, a.message_id)) AS is_duplicate FROM places a""",
)
def is_duplicate(spark, sf_dir):
    return T.is_duplicate(_hashes(spark, sf_dir))


@query(
    "deduplicated",
    f"""WITH {_SAVE_LOG} SELECT account, message_id, ingest_seq, body_text FROM log
      QUALIFY row_number() OVER (PARTITION BY body_text ORDER BY ingest_seq, account, message_id) = 1""",
)
def deduplicated(spark, sf_dir):
    log = _save_log(spark, sf_dir)
    hashed = log.withColumn("content_hash", T.content_hash(F.col("body_text")))
    return T.deduplicated(hashed).select("account", "message_id", "ingest_seq", "body_text")


@query(
    "live_raw_messages",
    f"""WITH raw AS (SELECT page_id AS seq, '' AS message_id, html, length(url) % 3 = 0 AS is_deleted FROM pages),
      d AS (SELECT doc_id AS seq, '' AS message_id FROM documents)
      SELECT account, message_id, sha256(html) AS content FROM {O.in_two_accounts('raw', 'seq')} r
      WHERE NOT is_deleted AND (account, message_id) IN (SELECT (account, message_id) FROM {O.in_two_accounts('d', 'seq')} d)""",
)
def live_raw_messages(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages")
    raw = V.in_two_accounts(pages, "page_id").select(
        "account",
        "message_id",
        F.encode("html", "UTF-8").alias("raw_message"),
        (F.length("url") % 3 == 0).alias("is_deleted"),
    )
    live = T.live_raw_messages(raw, V.in_two_accounts(V.mail(spark, sf_dir), "seq"))
    return live.select("account", "message_id", F.sha2("raw_message", 256).alias("content"))


_CHILDREN = {
    "training_data": ("labels", "doc_id"),
    "email_actions": ("events", "user_id"),
    "gmail_messages": ("events", "event_id"),
    "calendar_events": ("orders", "o_custkey"),
    "message_hashes": ("conversations", "conv_id"),
}


@query(
    "orphan_check",
    " UNION ALL ".join(
        f"""SELECT '{child}' AS child, count(*) AS child_rows,
          count(*) FILTER ({column} NOT IN (SELECT doc_id FROM documents)) AS orphan_rows,
          count(DISTINCT CASE WHEN {column} NOT IN (SELECT doc_id FROM documents) THEN {column} END) AS missing_parents
          FROM {name}"""
        for child, (name, column) in _CHILDREN.items()
    ),
)
def orphan_check(spark, sf_dir):
    children = {child: (V.table(spark, sf_dir, name), column) for child, (name, column) in _CHILDREN.items()}
    return T.orphan_check(children, V.table(spark, sf_dir, "documents"), "doc_id")


@query(
    "retention",
    f"""WITH {O.MAIL} SELECT message_id, sender FROM mail
      WHERE date_received >= TIMESTAMP '2025-06-30' - INTERVAL 30 DAY""",
)
def retention(spark, sf_dir):
    as_of = F.lit("2025-06-30").cast("timestamp")
    return T.retention(V.stored_mail(spark, sf_dir), as_of).select("message_id", "sender")


@query(
    "save_events",
    f"""SELECT id, email_id, event_type, title, strftime(due_date, {O.ISO}) AS due, priority, reminder_status
      FROM ({V.CALENDAR_SQL}) c""",
)
def save_events(spark, sf_dir):
    path = shared_dir(spark, "events")
    events = V.calendar_events(spark, sf_dir)
    K.append(events, path, "first")
    K.append(events, path, "first")
    saved = spark.read.schema(events.schema).option("basePath", path).parquet(path)
    return saved.select(
        "id", "email_id", "event_type", "title", iso("due_date").alias("due"), "priority", "reminder_status"
    )


@query(
    "pending_events",
    f"""SELECT id, title, strftime(due_date, {O.ISO}) AS due, priority FROM ({V.CALENDAR_SQL}) c
      WHERE NOT sync_approved AND NOT is_synced ORDER BY due_date ASC NULLS FIRST, id""",
)
def pending_events(spark, sf_dir):
    waiting = K.pending_events(V.calendar_events(spark, sf_dir))
    return waiting.select("id", "title", iso("due_date").alias("due"), "priority")


_DUE = "reminder_status IN ('pending', 'snoozed') AND next_reminder_at <= TIMESTAMP '1995-06-17'"


@query(
    "due_reminders",
    f"""WITH c AS ({V.CALENDAR_SQL}), r AS ({V.REMINDERS_SQL})
      SELECT c.id AS event_id, title, strftime(next_reminder_at, {O.ISO}) AS next_at, r.id AS reminder_id,
        strftime(reminder_time, {O.ISO}) AS reminder_at, reminder_type
      FROM c LEFT JOIN r ON r.event_id = c.id WHERE {_DUE}""",
)
def due_reminders(spark, sf_dir):
    as_of = F.lit("1995-06-17").cast("timestamp")
    due = K.due_reminders(V.calendar_events(spark, sf_dir), V.reminders(spark, sf_dir), as_of)
    return due.select(
        "event_id", "title", iso("next_reminder_at").alias("next_at"), "reminder_id",
        iso("reminder_time").alias("reminder_at"), "reminder_type",
    )


@query(
    "reminders_for_event",
    f"""WITH c AS ({V.CALENDAR_SQL}), r AS ({V.REMINDERS_SQL})
      SELECT event_id, r.id, strftime(reminder_time, {O.ISO}) AS reminder_at, reminder_type
      FROM r WHERE event_id IN (SELECT id FROM c WHERE reminder_status = 'snoozed')""",
)
def reminders_for_event(spark, sf_dir):
    events = V.calendar_events(spark, sf_dir).filter("reminder_status = 'snoozed'")
    found = K.reminders_for_event(V.reminders(spark, sf_dir), events)
    return found.select("event_id", "id", iso("reminder_time").alias("reminder_at"), "reminder_type")


@query(
    "reminder_schedule",
    f"""WITH c AS ({V.CALENDAR_SQL}), t AS (SELECT id AS event_id, due_date, hours_before,
        due_date - hours_before * INTERVAL 1 HOUR AS at_time
        FROM c, (VALUES (168), (48), (24), (3)) h(hours_before) WHERE due_date IS NOT NULL)
      SELECT event_id, hours_before, strftime(at_time, {O.ISO}) AS reminder_at,
        strftime(min(CASE WHEN at_time >= TIMESTAMP '1998-01-01' THEN at_time END) OVER (PARTITION BY event_id),
          {O.ISO}) AS next_at FROM t""",
)
def reminder_schedule(spark, sf_dir):
    plan = K.reminder_schedule(V.calendar_events(spark, sf_dir), F.lit("1998-01-01").cast("timestamp"))
    return plan.select(
        "event_id", "hours_before", iso("reminder_time").alias("reminder_at"), iso("next_reminder_at").alias("next_at")
    )


@query(
    "snooze",
    f"""WITH r AS ({V.REMINDERS_SQL}) SELECT id, event_id,
      strftime(coalesce(snooze_until, sent_at + INTERVAL 4 HOUR), {O.ISO}) AS returns FROM r
      WHERE user_action = 'snoozed'""",
)
def snooze(spark, sf_dir):
    back = K.snooze(V.reminders(spark, sf_dir))
    return back.select("id", "event_id", iso("returns_at").alias("returns"))


_SENT = f"""WITH {_SAVE_LOG} SELECT sender AS sender_email, split_part(sender, '@', 2) AS sender_domain,
  count(*) AS total_emails, strftime(max(struct_pack(a := ingest_seq, b := date_received)).b, {O.ISO}) AS last,
  strftime(min(date_received), {O.ISO}) AS first FROM log GROUP BY ALL"""


@query("sender_stats", _SENT)
def sender_stats(spark, sf_dir):
    saves = _save_log(spark, sf_dir).withColumn("ingest_time", F.col("date_received"))
    return S.sender_stats(saves).select(
        "sender_email", "sender_domain", "total_emails",
        iso("last_seen").alias("last"), iso("first_seen").alias("first"),
    )


@query(
    "sender_behaviour",
    f"""WITH {O.ADDITIVE}, {O.UPDATES}, acts AS (SELECT account, message_id,
        {", ".join(f"count(*) FILTER (action_type = '{k}') AS n_{k}" for k in ("read", "reply", "archive", "delete"))}
        FROM {O.in_two_accounts(f"({V.ACTIONS_SQL})", "mail_seq")} a GROUP BY 1, 2)
      SELECT sender AS sender_email, split_part(sender, '@', 2) AS sender_domain, count(*) AS total_emails,
        {", ".join(f"coalesce(sum(n_{k}), 0)::BIGINT AS {k}_count" for k in ("read", "reply", "archive", "delete"))},
        sum(CASE priority WHEN 'important' THEN 4 WHEN 'low' THEN 2 WHEN 'archive' THEN 1 END)::DOUBLE
          / count(priority)::DOUBLE AS avg_user_priority,
        count(*) FILTER (is_bot) * 2 > count(*) AS is_automated,
        strftime(min(date_received), {O.ISO}) AS first, strftime(max(date_received), {O.ISO}) AS last
      FROM {O.in_two_accounts("additive", "seq", "account, message_id")} a LEFT JOIN acts USING (account, message_id)
      LEFT JOIN {O.in_two_accounts("feedback", "update_seq")} f USING (account, message_id) GROUP BY 1, 2""",
)
def sender_behaviour(spark, sf_dir):
    scored = V.in_two_accounts(C.classify_additive(V.mail(spark, sf_dir)), "seq")
    told = V.in_two_accounts(V.feedback(spark, sf_dir), "update_seq")
    told = told.select("account", "message_id", F.col("priority").alias("user_priority"))
    mail = scored.select("account", "message_id", "sender", "date_received", "is_bot")
    mail = mail.join(told, ["account", "message_id"], "left")
    stats = S.sender_behaviour(mail, V.in_two_accounts(V.actions(spark, sf_dir), "mail_seq"))
    counts = [f"{k}_count" for k in ("read", "reply", "archive", "delete")]
    return stats.select(
        "sender_email", "sender_domain", "total_emails", *counts, "avg_user_priority", "is_automated",
        iso("first_seen").alias("first"), iso("last_seen").alias("last"),
    )


@query(
    "notify_feed",
    f"""WITH RECURSIVE {IMPORTANT}, feed AS (SELECT *, {O.SQUEEZED} AS squeezed FROM important
        WHERE known_sender OR has_word OR in_chain
        QUALIFY row_number() OVER (PARTITION BY account, date_received ORDER BY seq, message_id) = 1),
      ahead AS (SELECT account, date_received, min(date_received) OVER (PARTITION BY account ORDER BY date_received
        RANGE BETWEEN INTERVAL 5 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING) AS next_date FROM feed),
      sent AS (SELECT account, min(date_received) AS date_received FROM feed GROUP BY account
        UNION ALL SELECT account, next_date FROM sent JOIN ahead USING (account, date_received) WHERE next_date IS NOT NULL)
      SELECT account, message_id, strftime(date_received, {O.ISO}) AS sent,
        concat('From: ', sender, ' | Subject: ', subject, ' | Summary: ', {O.PREVIEW.format('squeezed', 100)}) AS line
      FROM feed JOIN sent USING (account, date_received)""",
)
def notify_feed(spark, sf_dir):
    mail, flags = important(spark, sf_dir)
    feed = S.notify_feed(mail, flags)
    return feed.select("account", "message_id", iso("sent_at").alias("sent"), "line")


_RULE_MATCH = """(condition_type = 'sender' AND condition_value = sender)
  OR (condition_type = 'domain' AND condition_value = domain)
  OR (condition_type = 'category' AND condition_value = category)
  OR (condition_type = 'subject_contains' AND contains(low_subject, lower(condition_value)))"""


@query(
    "apply_rules",
    f"""WITH {O.MAIL}, rules AS ({V.RULES_SQL}), m AS (SELECT *, {O.DOMAIN_LEARN} AS domain FROM mail)
      SELECT 'gmail' AS provider, account, message_id, action_type, id AS rule_id, action_value
      FROM m JOIN rules ON is_active AND ({_RULE_MATCH})
      QUALIFY row_number() OVER (PARTITION BY account, message_id, action_type ORDER BY priority, id) = 1""",
)
def rules(spark, sf_dir):
    mail = V.mail(spark, sf_dir).withColumn("domain", sender_domain_learn(F.col("sender")))
    return apply_rules(mail, V.rules(spark, sf_dir))


_FEATURES = f"""{O.ADDITIVE}, {O.UPDATES}, samples AS (SELECT account, message_id, date_received, score,
  body_length::DOUBLE AS body_length, {O.LINE_MEAN} AS line_length, urls::DOUBLE AS url_count,
  hour(date_received)::DOUBLE AS hour,
  (CASE WHEN indicators = '' THEN 0 ELSE len(string_split(indicators, '|')) END)::DOUBLE AS indicators,
  (CASE WHEN header_kind <> 'plain' THEN 2 WHEN seq % 8 = 0 THEN 3 ELSE 4 END)::DOUBLE AS recipients,
  has_attachment::INT::DOUBLE AS has_attachment, contains(low_subject, 're:')::INT::DOUBLE AS is_reply,
  {O.SIGNATURE}::INT::DOUBLE AS has_signature, priority AS label_priority, category AS label_category,
  priority IS NOT NULL AS is_validated
  FROM {O.in_two_accounts("additive", "seq", "account, message_id, category")} a
  LEFT JOIN {O.in_two_accounts("feedback", "update_seq")} f USING (account, message_id))"""
_FEATURE_NAMES = [
    "score", "body_length", "line_length", "url_count", "hour", "indicators", "recipients",
    "has_attachment", "is_reply", "has_signature",
]


def _samples(spark, sf_dir):
    told = V.in_two_accounts(V.feedback(spark, sf_dir), "update_seq").select("account", "message_id", "priority", "category")
    return M.build_training_set(V.in_two_accounts(V.mail(spark, sf_dir), "seq"), told)


def _spread_features(samples, *others):
    return samples.select(
        "account", "message_id", *[F.col("features")[name].alias(name) for name in _FEATURE_NAMES], *others
    )


@query(
    "build_training_set",
    f"""WITH {_FEATURES} SELECT account, message_id, {", ".join(_FEATURE_NAMES)}, label_priority, label_category, is_validated
      FROM samples""",
)
def build_training_set(spark, sf_dir):
    return _spread_features(_samples(spark, sf_dir), "label_priority", "label_category", "is_validated")


@query(
    "save_training",
    f"""WITH {_FEATURES} SELECT account, message_id, {", ".join(_FEATURE_NAMES)}, label_priority, is_validated FROM samples""",
)
def save_training(spark, sf_dir):
    path = shared_dir(spark, "training")
    samples = _samples(spark, sf_dir)
    K.append(samples, path, "first")
    saved = spark.read.schema(samples.schema).option("basePath", path).parquet(path)
    return _spread_features(saved, "label_priority", "is_validated")


@query(
    "validated_training",
    f"""WITH {_FEATURES} SELECT account, message_id, {", ".join(_FEATURE_NAMES)}, label_priority, label_category FROM samples
      WHERE is_validated ORDER BY date_received DESC, account, message_id""",
)
def validated_training(spark, sf_dir):
    return _spread_features(M.validated_training(_samples(spark, sf_dir)), "label_priority", "label_category")


@query(
    "model_metrics",
    f"""WITH {O.ADDITIVE}, {O.UPDATES}, j AS (SELECT priority AS label, CASE WHEN score < 0.3::DOUBLE THEN 'important'
        WHEN score < 0.7::DOUBLE THEN 'low' ELSE 'archive' END AS predicted
        FROM (SELECT * EXCLUDE (category) FROM additive) a JOIN feedback USING (message_id)),
      k AS (SELECT DISTINCT label AS class FROM j UNION SELECT DISTINCT predicted FROM j),
      c AS (SELECT class, (SELECT count(*) FROM j WHERE label = class) AS support,
        (SELECT count(*) FROM j WHERE predicted = class) AS named,
        (SELECT count(*) FROM j WHERE predicted = class AND label = class) AS hits FROM k)
      SELECT class, CASE WHEN named > 0 THEN hits::DOUBLE / named::DOUBLE END AS precision,
        CASE WHEN support > 0 THEN hits::DOUBLE / support::DOUBLE END AS recall,
        (hits * 2)::DOUBLE / (named + support)::DOUBLE AS f1, support,
        (SELECT count(*) FILTER (label = predicted)::DOUBLE / count(*)::DOUBLE FROM j) AS accuracy,
        (SELECT count(*) FROM j) AS samples FROM c""",
)
def model_metrics(spark, sf_dir):
    scored = C.classify_additive(V.mail(spark, sf_dir))
    band = C.confidence_band(F.col("score"))
    guess = F.when(band == "low", "important").when(band == "uncertain", "low").otherwise("archive")
    told = V.feedback(spark, sf_dir).select("message_id", F.col("priority").alias("label"))
    return M.model_metrics(scored.select("message_id", guess.alias("predicted")).join(told, "message_id"))


@query(
    "feature_importance_top",
    f"""WITH {O.LEARNED} SELECT 2 AS version, concat(category, ':', pattern) AS feature_name,
      weight AS importance_score FROM learned""",
)
def feature_importance_top(spark, sf_dir):
    mail = L.in_window(V.mail(spark, sf_dir), F.lit("2025-12-31").cast("timestamp"))
    path = shared_dir(spark, "scores")
    L.save_weights(L.default_weights(spark), path, "gmail", "main", 1)
    L.save_weights(L.learn_weights(L.pattern_counts(mail), mail), path, "gmail", "main", 2)
    scores = L.read_weights(spark, path).select(
        "version", F.concat_ws(":", "category", "pattern").alias("feature_name"),
        F.col("weight").alias("importance_score"),
    )
    versions = spark.createDataFrame([(1, False), (2, True)], "version long, is_active boolean")
    return M.feature_importance_top(scores, versions)


_LABELS = f"""acts AS (SELECT * FROM {O.in_two_accounts(f"({V.ACTIONS_SQL})", "mail_seq")} a),
  ops AS (SELECT account, message_id, unnest(CASE WHEN seq % 5 = 0 THEN ['INBOX', 'UNREAD', 'STARRED']
      ELSE ['INBOX', 'UNREAD'] END) AS label, TRUE AS added, -1 AS seq
      FROM {O.in_two_accounts("mail", "seq", "account, message_id")} m
    UNION ALL SELECT account, message_id, CASE action_type WHEN 'read' THEN 'UNREAD' WHEN 'star' THEN 'STARRED'
      WHEN 'unstar' THEN 'STARRED' WHEN 'delete' THEN 'TRASH' WHEN 'archive' THEN 'ARCHIVED' END,
      action_type NOT IN ('read', 'unstar'), seq FROM acts
      WHERE action_type IN ('read', 'star', 'unstar', 'delete', 'archive')
    UNION ALL SELECT account, message_id, r_name, TRUE, seq FROM acts JOIN region ON lower(r_name) = lower(action_value)
      AND account = concat('acct-', r_regionkey % 2) WHERE action_type = 'move'),
  last AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY account, message_id, label ORDER BY seq DESC) = 1),
  state AS (SELECT account, message_id,
    array_to_string(list_sort(list(CASE WHEN added THEN label END) FILTER (added)), '|') AS labels,
    count(*) FILTER (added AND label = 'ARCHIVED') > 0 AS is_archived FROM last GROUP BY 1, 2)"""
ACTION_STATE = f"""WITH {O.MAIL}, {_LABELS} SELECT * FROM state"""


def shared_actions(spark, sf_dir):
    """Mail and actions of two accounts that share their message ids."""
    mail = V.in_two_accounts(V.mail(spark, sf_dir), "seq")
    return mail, V.in_two_accounts(V.actions(spark, sf_dir), "mail_seq")


@query("action_state", ACTION_STATE)
def action_state(spark, sf_dir):
    state = A.action_state(*shared_actions(spark, sf_dir), V.known_labels(spark, sf_dir))
    return state.select("account", "message_id", joined("labels").alias("labels"), "is_archived")


@query(
    "action_counts",
    f"""SELECT account, message_id, action_type, count(*) AS n, strftime(min(ts), {O.ISO}) AS first,
      strftime(max(ts), {O.ISO}) AS last FROM {O.in_two_accounts(f"({V.ACTIONS_SQL})", "mail_seq")} a GROUP BY 1, 2, 3""",
)
def action_counts(spark, sf_dir):
    counts = A.action_counts(shared_actions(spark, sf_dir)[1])
    return counts.select(
        "account", "message_id", "action_type", "n", iso("first_at").alias("first"), iso("last_at").alias("last")
    )


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


_CLEANED = f"""WITH raw AS ({V.FIELDS_SQL}), cleaned AS (SELECT seq, {_strip('message_id')} AS message_id,
    {_strip('thread_id')} AS thread_id, {_strip('label')} AS label, lower({_strip('email')}) AS email,
    replace(replace({_strip('filename')}, '/', '_'), chr(92), '_') AS filename,
    {_strip("substr(regexp_replace(subject, '[\\x01-\\x09\\x0b-\\x1f]', '', 'g'), 1, 1000)")} AS subject,
    confidence, lower({_strip('priority')}) AS priority, lower({_strip('category')}) AS category FROM raw),
  marked AS (SELECT *, concat_ws('|',
    CASE WHEN NOT regexp_full_match(message_id, '[a-fA-F0-9]{{16,}}') THEN 'message_id' END,
    CASE WHEN NOT regexp_full_match(thread_id, '[a-fA-F0-9]{{16,}}') THEN 'thread_id' END,
    CASE WHEN NOT regexp_full_match(label, '[\\p{{L}}\\p{{N}}_\\s/-]{{1,100}}') THEN 'label' END,
    CASE WHEN NOT regexp_full_match(email, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') OR length(email) > 254
      THEN 'email' END,
    CASE WHEN filename = '' OR length(filename) > 255 OR starts_with(filename, '.') THEN 'filename' END,
    CASE WHEN NOT (confidence >= 0 AND confidence <= 1) THEN 'confidence' END,
    CASE WHEN coalesce(priority, '') NOT IN ('critical', 'important', 'normal', 'low', 'archive') THEN 'priority' END,
    CASE WHEN category NOT IN ('personal', 'work', 'newsletter', 'marketing', 'transactional', 'social', 'other')
      THEN 'category' END) AS violations FROM cleaned)"""


@query("quarantine", f"{_CLEANED} SELECT * FROM marked")
def quarantine(spark, sf_dir):
    return Q.quarantine(V.fields(spark, sf_dir)).withColumn("violations", joined("violations"))


@query(
    "dq_summary",
    f"""{_CLEANED}, r AS (SELECT unnest(string_split(violations, '|')) AS rule FROM marked WHERE violations <> '')
      SELECT rule, count(*) AS rejected FROM r GROUP BY 1""",
)
def dq_summary(spark, sf_dir):
    return Q.dq_summary(Q.quarantine(V.fields(spark, sf_dir)))


_MASKED = r"""regexp_replace(text, '\b([a-zA-Z0-9._%+-])([a-zA-Z0-9._%+-]*)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b',
  '\1***@\3', 'g')"""


@query(
    "mask_pii",
    rf"SELECT doc_id, regexp_replace({_MASKED}, '\b[a-zA-Z0-9]{{32,}}\b', '[TOKEN]', 'g') AS text FROM documents",
)
def mask_pii(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", P.mask_data(F.col("text")).alias("text"))


_LOG_MASKED = rf"""regexp_replace(regexp_replace({_MASKED}, '\b[a-zA-Z0-9+/=]{{32,}}\b', '[TOKEN]', 'g'),
  '(password|key|token|secret|auth)["'']?\s*[:=]\s*["'']?([^\s"'']+)', '\1=***', 'gi')"""


@query(
    "mask_log",
    f"""WITH m AS (SELECT doc_id, {_LOG_MASKED} AS text FROM documents), l AS (SELECT *, lower(text) AS low FROM m)
      SELECT doc_id, text, {" ".join(["CASE"] + [
          f"WHEN contains(low, '{w}') THEN concat(substr(text, 1, instr(low, '{w}') + {len(w) - 1}), ' [REDACTED]')"
          for w in ("body:", "content:", "message:", "text:")] + ["ELSE text END"])} AS redacted FROM l""",
)
def mask_log(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", P.mask_log(F.col("text")).alias("text"))
    return docs.withColumn("redacted", P.redact_body(F.col("text")))
