"""Per-sender statistics and the notification feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.functions.features import mail_preview, sender_domain_store
from mailgrain.operators.cooldown import taken
from mailgrain.operators.joins import identity, joined_null_safe
from mailgrain.session import stored

# Our scale for the mean of user priorities.
PRIORITY_VALUES = {"critical": 5, "important": 4, "normal": 3, "low": 2, "archive": 1}
# Fixed value: minutes between notifications.
COOLDOWN_MINUTES = 5


def sender_parts(saves: DataFrame) -> DataFrame:
    """Mergeable statistics of a set of saves: sender, count, last save and first insert.

    ``saves``: sender, date_received, ingest_seq, ingest_time.
    """
    last = F.max(F.struct("ingest_seq", "date_received"))
    return saves.groupBy("sender").agg(
        F.count(F.lit(1)).alias("saves"), last.alias("last"), F.min("ingest_time").alias("first_seen")
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """Parts of any number of batches to one part; the order of merging is immaterial."""
    return parts.groupBy("sender").agg(
        F.sum("saves").alias("saves"), F.max("last").alias("last"), F.min("first_seen").alias("first_seen")
    )


def merge_sender_parts(parts: DataFrame) -> DataFrame:
    """Parts of any number of batches to one row per sender."""
    return merged_parts(parts).select(
        F.col("sender").alias("sender_email"),
        sender_domain_store(F.col("sender")).alias("sender_domain"),
        F.col("saves").alias("total_emails"),
        "first_seen",
        F.col("last.date_received").alias("last_seen"),
    )


def sender_stats(saves: DataFrame) -> DataFrame:
    """Counts saves, re-saves included; last seen is the date of the last save in arrival order."""
    return merge_sender_parts(sender_parts(saves))


def priority_value(priority: Column) -> Column:
    value = F.lit(None).cast("int")
    for word, number in PRIORITY_VALUES.items():
        value = F.when(priority == word, number).otherwise(value)
    return value


def sender_behaviour(mail: DataFrame, actions: DataFrame) -> DataFrame:
    """What the user does with each sender's mail.

    ``mail``: its identity, sender, date_received, is_bot, user_priority. ``actions``: the message's identity and
    action_type. Actions are counted per message before the join, so a message with very many
    actions weighs one row in it.
    """
    of = lambda kind: F.count_if(F.col("action_type") == kind)
    kinds = ["read", "reply", "archive", "delete"]
    per_mail = actions.groupBy(*identity(actions)).agg(*[of(kind).alias(kind) for kind in kinds])
    added = lambda kind: F.coalesce(F.sum(kind), F.lit(0)).alias(f"{kind}_count")
    bots = F.sum(F.col("is_bot").cast("int"))
    grouped = (
        mail.join(per_mail, identity(actions), "left")
        .groupBy("sender")
        .agg(
            F.count(F.lit(1)).alias("total_emails"),
            *[added(kind) for kind in kinds],
            F.avg(priority_value(F.col("user_priority"))).alias("avg_user_priority"),
            (bots * 2 > F.count(F.lit(1))).alias("is_automated"),
            F.min("date_received").alias("first_seen"),
            F.max("date_received").alias("last_seen"),
        )
    )
    domain = sender_domain_store(F.col("sender"))
    return grouped.withColumn("sender_domain", domain).withColumnRenamed("sender", "sender_email")


def notify_feed(mail: DataFrame, flags: DataFrame, minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """Important mail as one line each: an account's first, then always the first that comes ``minutes`` or more behind the
    last one shown.

    Of mail that an account got at one time the first by ``seq`` and message counts. Lines are cut to size
    before the join, so no body is shuffled, and only times go through the cooldown. Mail without a date is not shown.
    ``mail``: account, message_id, sender, subject, body_text, date_received, seq.
    ``flags``: the message's identity and is_important, unique per message.
    """
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("From: "), F.col("sender")),
        F.concat(F.lit("Subject: "), F.col("subject")),
        F.concat(F.lit("Summary: "), mail_preview(F.col("body_text"))),
    )
    owner = [k for k in identity(mail) if k != "message_id"]
    shown = mail.filter("date_received IS NOT NULL").select(*identity(mail), "date_received", "seq", line.alias("line"))
    first = F.min(F.struct("seq", "message_id", "date_received", "line"))
    lines = (
        shown.join(flags.filter("is_important"), identity(flags), "left_semi")
        .groupBy(*owner, F.unix_micros("date_received").alias("t"))
        .agg(first.alias("f"))
    )
    lines = stored(lines, "lines")
    sent = taken(lines.select(*owner, "t"), owner, minutes * 60_000_000)
    return joined_null_safe(lines, sent, [*owner, "t"], "left_semi").select(
        "account", "f.message_id", F.col("f.date_received").alias("sent_at"), "f.line"
    )
