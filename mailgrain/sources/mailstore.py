"""Stored tables: imports of dumped rows, and Parquet layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _list(column: str) -> Column:
    return F.from_json(column, "array<string>")


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column) != 0, F.lit(False))


def _time(column: str) -> Column:
    return F.try_to_timestamp(F.nullif(F.col(column), F.lit("")))


def decode_stored_mail(rows: DataFrame) -> DataFrame:
    """Dumped mail rows: JSON text to lists and maps, ISO text to times, 0/1 to booleans."""
    decoded = {
        "recipients": F.coalesce(_list("recipients"), F.array().cast("array<string>")),
        "headers": F.from_json("headers", "map<string,string>"),
        "labels": _list("labels"),
        "gmail_labels": _list("gmail_labels"),
        **{c: _time(c) for c in ("date_received", "date_processed", "feedback_date")},
        **{c: _flag(c) for c in ("is_uncertain", "is_processed", "is_archived", "needs_review")},
    }
    return rows.select(*[decoded.get(c, F.col(c)).alias(c) for c in rows.columns])


def decode_stored_event(rows: DataFrame) -> DataFrame:
    """Dumped calendar rows, likewise."""
    times = ("start_datetime", "end_datetime", "due_date", "next_reminder_at", "created_at", "updated_at")
    decoded = {**{c: _time(c) for c in times}, **{c: _flag(c) for c in ("is_synced", "sync_approved")}}
    return rows.select(*[decoded.get(c, F.col(c)).alias(c) for c in rows.columns])


def write_mail(mail: DataFrame, path: str, mode: str = "append", unit: str = "day") -> None:
    """Mail by received date, files sorted by id: windows prune folders, lookups skip row groups.

    Rows are balanced by date; adaptive execution splits busy dates over several tasks and joins
    small ones. ``unit`` is the span of one folder, wider for small mailboxes.
    """
    dated = mail.withColumn("received_on", F.to_date(F.date_trunc(unit, "date_received")))
    (
        dated.hint("rebalance", "received_on")
        .sortWithinPartitions("received_on", "message_id")
        .write.mode(mode)
        .partitionBy("received_on")
        .parquet(path)
    )


def read_mail(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", path).parquet(path)


def folders_between(mail: DataFrame, start: Column, end: Column | None = None, widest: str = "year") -> DataFrame:
    """Only the folders that can hold mail from ``start`` to ``end``; exact tests come after.

    A folder is named by the first day of its span, and no span is wider than ``widest``. Mail that is not
    stored in dated folders passes as it is.
    """
    if "received_on" not in mail.columns:
        return mail
    folder = F.col("received_on")
    since = mail.filter(folder >= F.to_date(F.date_trunc(widest, start)))
    return since if end is None else since.filter(folder <= F.to_date(end))
