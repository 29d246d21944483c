"""Provider exports to the one message shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailgrain import schemas
from mailgrain.functions import mime
from mailgrain.operators.joins import identity
from mailgrain.operators.learn import in_window

# Fixed value: the default window in months.
WINDOW_MONTHS = 24


def _read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a declared schema; a line that is no JSON lands in ``_damaged``."""
    kept = schema.add("_damaged", "string") if "_damaged" not in schema.names else schema
    return spark.read.schema(kept).option("columnNameOfCorruptRecord", "_damaged").json(path)


def read_gmail(spark: SparkSession, path: str) -> DataFrame:
    return _read_lines(spark, path, type(schemas.GMAIL)(list(schemas.GMAIL.fields)))


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    return _read_lines(spark, path, type(schemas.PROTON)(list(schemas.PROTON.fields)))


def stream_gmail(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a nested export as a stream of files."""
    kept = type(schemas.GMAIL)(list(schemas.GMAIL.fields)).add("_damaged", "string")
    return spark.readStream.schema(kept).option("columnNameOfCorruptRecord", "_damaged").json(path)


def sound(raw: DataFrame) -> DataFrame:
    """The messages of an export without its damaged lines; those are what ``_damaged`` holds."""
    return raw.filter("_damaged IS NULL").drop("_damaged")


def parse_gmail(raw: DataFrame, account: str, lenient: bool = False) -> DataFrame:
    """Nested export to mail. A body that cannot be decoded is NULL and can be quarantined by it.

    ``lenient`` picks the second body rule. ``seq`` is the received time in ms; ties are broken by
    ``message_id`` wherever an order is asked for.
    """
    payload = F.col("payload")
    body = mime.body_text_lenient(payload) if lenient else mime.body_text(payload)
    parsed = raw.withColumn("_h", mime.header_map(payload["headers"]))
    return parsed.select(
        F.lit("gmail").alias("provider"),
        F.lit(account).alias("account"),
        F.col("id").alias("message_id"),
        F.col("threadId").alias("thread_id"),
        F.coalesce(F.col("_h")["from"], F.lit("")).alias("sender"),
        mime.recipients(F.col("_h")).alias("recipients"),
        F.coalesce(F.col("_h")["subject"], F.lit("")).alias("subject"),
        mime.message_time(F.col("internalDate")).alias("date_received"),
        body.alias("body_text"),
        mime.body_html(payload).alias("body_html"),
        F.col("_h").alias("headers"),
        mime.has_attachment(payload).alias("has_attachment"),
        F.col("internalDate").try_cast("bigint").alias("seq"),
    )


def unreadable(mail: DataFrame) -> DataFrame:
    """Parsed messages whose body or time could not be read: the ones to quarantine."""
    return mail.filter(F.col("body_text").isNull() | F.col("date_received").isNull())


def parse_flat(raw: DataFrame, account: str) -> DataFrame:
    """Flat export to mail: recipients are a list already, times are whole seconds."""
    return raw.select(
        F.lit("protonmail").alias("provider"),
        F.lit(account).alias("account"),
        F.col("id").alias("message_id"),
        F.col("from").alias("sender"),
        F.col("to").alias("recipients"),
        "subject",
        F.timestamp_seconds("time").alias("date_received"),
        F.col("body").alias("body_text"),
        "headers",
        (F.col("time") * 1000).alias("seq"),
    )


def union_accounts(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Accounts of any provider in one frame of the full mail shape; absent columns are NULL."""
    merged = first
    for other in others:
        merged = merged.unionByName(other, allowMissingColumns=True)
    have = set(merged.columns)
    return merged.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.MAIL.fields
        ]
    )


def recent_gmail(raw: DataFrame, account: str, size: int) -> DataFrame:
    """The newest ``size`` messages of a nested export: chosen before any body is decoded."""
    newest = raw.orderBy(F.col("internalDate").try_cast("bigint").desc(), F.col("id")).limit(size)
    return parse_gmail(newest, account)


def recent(mail: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` messages, newest first; the sort stops at so many rows per task."""
    return mail.orderBy(F.col("date_received").desc(), *identity(mail)).limit(size)


def window_scan(mail: DataFrame, as_of: Column, months_back: int = WINDOW_MONTHS, size: int | None = None) -> DataFrame:
    """The messages of a window, or its newest ``size``; of a date-partitioned table only its folders are read."""
    found = in_window(mail, as_of, months_back)
    return found if size is None else recent(found, size)
