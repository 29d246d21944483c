"""Quarantine: which rows break which field rules, and what the cleaned values are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.functions import privacy as P
from mailgrain.functions.text import exploded, labelled


def checks() -> list[P.Check]:
    """All field rules over their usual column names."""
    return [
        P.check_id("message_id", F.col("message_id")),
        P.check_id("thread_id", F.col("thread_id")),
        P.check_label(F.col("label")),
        P.check_email(F.col("email")),
        P.check_filename(F.col("filename")),
        P.check_confidence(F.col("confidence")),
        P.check_priority(F.col("priority")),
        P.check_category(F.col("category")),
    ]


def quarantine(rows: DataFrame) -> DataFrame:
    """Cleaned columns and the list of broken rules; rows are marked and never dropped.

    The rules for columns the table lacks are left out, a ``subject`` is cleaned and never rejected.
    """
    used = [c for c in checks() if c.name in rows.columns]
    cleaned = {c.name: c.clean for c in used}
    if "subject" in rows.columns:
        cleaned["subject"] = P.clean_subject(F.col("subject"))
    broken = labelled(*[(~c.ok, c.name) for c in used])
    kept: list[Column] = [cleaned.get(c, F.col(c)).alias(c) for c in rows.columns]
    return rows.select(*kept, broken.alias("violations"))


def clean_rows(marked: DataFrame) -> DataFrame:
    return marked.filter(F.size("violations") == 0).drop("violations")


def rejected_rows(marked: DataFrame) -> DataFrame:
    return marked.filter(F.size("violations") > 0)


def dq_summary(marked: DataFrame) -> DataFrame:
    """Rejected rows per rule, rules without any left out."""
    return (
        exploded(marked, F.col("violations"), "rule")
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("rejected"))
    )
