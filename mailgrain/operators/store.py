"""The mail store: append-only logs, latest-wins views, review queue, duplicates, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailgrain.functions.features import content_hash
from mailgrain.operators.joins import identity, pick_per_key, salted_join
from mailgrain.session import stored
from mailgrain.sources.mailstore import folders_between


def latest_saves(saves: DataFrame) -> DataFrame:
    """Upsert by message: the last save replaces the whole row. Saves of one message with one ``ingest_seq``
    are ordered by their date."""
    return pick_per_key(saves, identity(saves), ["ingest_seq", "date_received"], latest=True)


def by_ids(mail: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Lookup of many ids at once; a single id is a plain filter on ``key``."""
    return mail.join(ids.select(key).distinct(), key, "left_semi")


def with_store_defaults(mail: DataFrame) -> DataFrame:
    """Add the classification, feedback and status columns a new row starts with."""
    text, flag = F.lit(None).cast("string"), F.lit(False)
    return mail.select(
        "*",
        text.alias("classification_priority"),
        text.alias("classification_category"),
        F.lit(None).cast("double").alias("confidence_score"),
        flag.alias("is_uncertain"),
        text.alias("user_priority"),
        text.alias("user_category"),
        F.lit(None).cast("timestamp").alias("feedback_date"),
        flag.alias("is_processed"),
        flag.alias("is_archived"),
        flag.alias("needs_review"),
        F.lit(None).cast("timestamp").alias("date_processed"),
    )


def _last(updates: DataFrame, fields: list[str]) -> DataFrame:
    newest = F.max_by(F.struct(*fields), F.struct("update_seq", *fields))
    return updates.groupBy(*identity(updates)).agg(newest.alias("u"))


def apply_classification(store: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold classification updates into the store; the last per message counts.

    ``updates``: message_id, priority, category, confidence, is_uncertain, updated_at, update_seq.
    Updates are reduced to one per message before the join, so both sides are unique.
    """
    fields = ["priority", "category", "confidence", "is_uncertain", "updated_at"]
    hit = F.col("u").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    changed = {
        "classification_priority": F.col("u.priority"),
        "classification_category": F.col("u.category"),
        "confidence_score": F.col("u.confidence"),
        "is_uncertain": F.col("u.is_uncertain"),
        "needs_review": F.col("u.is_uncertain"),
        "is_processed": F.lit(True),
        "date_processed": F.col("u.updated_at"),
    }
    joined = store.join(_last(updates, fields), identity(updates), "left")
    return joined.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in store.columns])


def apply_feedback(store: DataFrame, feedback: DataFrame) -> DataFrame:
    """Fold user feedback in; a missing category erases the stored one.

    ``feedback``: message_id, priority, category, given_at, update_seq.
    """
    hit = F.col("u").isNotNull()
    pick = lambda new, old: F.when(hit, new).otherwise(F.col(old)).alias(old)
    changed = {
        "user_priority": F.col("u.priority"),
        "user_category": F.col("u.category"),
        "feedback_date": F.col("u.given_at"),
        "needs_review": F.lit(False),
    }
    joined = store.join(_last(feedback, ["priority", "category", "given_at"]), identity(feedback), "left")
    return joined.select(*[pick(changed[c], c) if c in changed else F.col(c) for c in store.columns])


def _newest(rows: DataFrame, size: int | None) -> DataFrame:
    ordered = rows.orderBy(F.col("date_received").desc(), *identity(rows))
    return ordered if size is None else ordered.limit(size)


def unprocessed_emails(store: DataFrame, size: int | None = None) -> DataFrame:
    return _newest(store.filter(~F.col("is_processed")), size)


def emails_for_review(store: DataFrame, size: int | None = None) -> DataFrame:
    return _newest(store.filter(F.col("needs_review") & ~F.col("is_archived")), size)


def hashed(mail: DataFrame, content: str = "body_text") -> DataFrame:
    return mail.select(*identity(mail), "ingest_seq", content_hash(F.col(content)).alias("content_hash"))


def store_hashes(hashes: DataFrame) -> DataFrame:
    """The first hash stored for a message stays."""
    first = F.min(F.struct("ingest_seq", "content_hash")).alias("f")
    return hashes.groupBy(*identity(hashes)).agg(first).select(*identity(hashes), "f.content_hash", "f.ingest_seq")


def is_duplicate(hashes: DataFrame) -> DataFrame:
    """Whether another message had the same content earlier; a message's own re-saves are none.

    Saves with one ``ingest_seq`` are ordered by message. Per content the first two messages are found, each by
    its first save, and a save is compared with whichever is not of its own message. The hashes are stored once, for they
    are read several times; of a content in a third of all mail each task sends on two messages only, and its saves are spread
    in the join.
    """
    keys = identity(hashes)
    hashes = stored(hashes.select(*keys, "ingest_seq", "content_hash"), "hashes")
    place = F.struct("ingest_seq", *keys)
    firsts = hashes.filter("content_hash IS NOT NULL").groupBy("content_hash", *keys).agg(F.min("ingest_seq").alias("ingest_seq"))
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy("ingest_seq", *keys))
    two = firsts.withColumn("rank", rank).filter("rank <= 2").groupBy("content_hash")
    known = two.agg(*[F.min(F.when(F.col("rank") == n, place)).alias(c) for n, c in ((1, "first"), (2, "second"))])
    known = known.filter("second IS NOT NULL")
    marked = salted_join(hashes, known, ["content_hash"], F.xxhash64("ingest_seq", *keys), "left")
    own_first = F.struct(*keys).eqNullSafe(F.struct(*(F.col(f"first.{k}") for k in keys)))
    rival = F.when(own_first, F.col("second")).otherwise(F.col("first"))
    return marked.select(*keys, "ingest_seq", "content_hash", F.coalesce(rival < place, F.lit(False)).alias("is_duplicate"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first row of each ``content_hash`` in the order of ``ingest_seq``, then of messages."""
    return pick_per_key(rows, ["content_hash"], ["ingest_seq", *identity(rows)], latest=False)


def orphan_check(children: dict[str, tuple[DataFrame, str]], parents: DataFrame, key: str) -> DataFrame:
    """Rows per child table whose parent is missing.

    ``children`` maps a table name to its frame and its foreign key column. Children are counted
    per foreign key first, so a parent with very many children weighs one row in the join.
    """
    counted = None
    for name, (rows, column) in children.items():
        part = rows.groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias("n"))
        part = part.withColumn("child", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    known = parents.select(key).distinct().withColumn("_known", F.lit(True))
    missing = F.col("_known").isNull()
    return (
        counted.join(known, key, "left")
        .groupBy("child")
        .agg(
            F.sum("n").alias("child_rows"),
            F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("orphan_rows"),
            F.count_if(missing).alias("missing_parents"),
        )
    )


def cascade(rows: DataFrame, parents: DataFrame, column: str, key: str) -> DataFrame:
    """What a cascading delete would keep."""
    return rows.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def live_raw_messages(raw: DataFrame, mail: DataFrame) -> DataFrame:
    """Raw messages not marked deleted whose mail is still stored."""
    return raw.filter(~F.col("is_deleted")).join(mail.select(*identity(raw)), identity(raw), "left_semi")


def retention(mail: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Mail of the last ``days`` days; of a date-partitioned table older folders are not read."""
    start = as_of - F.make_dt_interval(days=F.lit(days))
    return folders_between(mail, start).filter(F.col("date_received") >= start)
