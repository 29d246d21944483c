"""The mailbox report: totals, top lists, histogram, advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mailgrain.functions import features as X
from mailgrain.functions.text import exploded
from mailgrain.operators.classify import any_case, classify_additive

# List lengths printed and saved, and the bounds of the advice tiers.
PRINTED = {"senders": 15, "domains": 15, "indicators": 15, "words": 20}
SAVED = {"senders": 50, "domains": 50, "words": 100}
FEW_MESSAGES, HIGH_BOT_SHARE = 500, 0.7


def analysed(mail: DataFrame) -> DataFrame:
    """What the report needs of each message; the body is left behind."""
    return classify_additive(mail).select(
        "seq",
        "sender",
        X.sender_domain_report(F.col("sender")).alias("sender_domain"),
        "subject",
        F.coalesce(F.length("body_text"), F.lit(0)).alias("body_length"),
        X.hour_header(any_case(F.col("headers"), "date")).alias("hour"),
        "score",
        "is_bot",
        "indicators",
        "indicator_groups",
    )


def mailbox_stats(rows: DataFrame) -> DataFrame:
    """Totals, distinct senders and domains, mean length.

    Distinct values come from grouping by sender, then by domain: each step is reduced before its
    shuffle, and rows are never multiplied as they are for several distinct counts at once.
    """
    by_sender = rows.groupBy("sender", "sender_domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_bot").cast("bigint")).alias("bots"),
        F.sum(F.col("body_length").cast("bigint")).alias("chars"),
    )
    by_domain = by_sender.groupBy("sender_domain").agg(
        F.sum("n").alias("n"),
        F.sum("bots").alias("bots"),
        F.sum("chars").alias("chars"),
        F.count(F.lit(1)).alias("senders"),
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    bots = F.coalesce(F.sum("bots"), F.lit(0))
    return by_domain.agg(
        total.alias("total_emails"),
        (total - bots).alias("human_emails"),
        bots.alias("bot_emails"),
        F.coalesce(F.sum("senders"), F.lit(0)).alias("unique_senders"),
        F.count(F.lit(1)).alias("unique_domains"),
        F.coalesce(F.try_divide(F.sum("chars"), total), F.lit(0.0)).alias("avg_length"),
    )


def mailbox_stats_approx(rows: DataFrame, rsd: float = 0.01) -> DataFrame:
    """The same in one pass with sketched distinct counts, for when exact ones are not needed."""
    return rows.agg(
        F.count(F.lit(1)).alias("total_emails"),
        F.approx_count_distinct("sender", rsd).alias("unique_senders"),
        F.approx_count_distinct("sender_domain", rsd).alias("unique_domains"),
    )


def mailbox_percentages(stats: DataFrame) -> DataFrame:
    """Whole percent, rounded down; NULL for an empty mailbox."""
    share = lambda n: F.expr(f"case when total_emails > 0 then {n} * 100 div total_emails end")
    return stats.select(
        "total_emails",
        share("human_emails").alias("human_percent"),
        share("bot_emails").alias("bot_percent"),
    )


def mailbox_profile(stats: DataFrame) -> DataFrame:
    ratio = F.coalesce(F.try_divide("bot_emails", "total_emails"), F.lit(0.0))
    tier = (
        F.when(F.col("total_emails") < FEW_MESSAGES, "limited")
        .when(ratio > HIGH_BOT_SHARE, "high_bot")
        .otherwise("balanced")
    )
    return stats.select("total_emails", ratio.alias("bot_ratio"), tier.alias("tier"))


def _position(seq: Column, place: Column) -> Column:
    """Order of first sight as one number, so that it aggregates without sorting rows."""
    return seq.cast("decimal(38,0)") * F.lit(10**10).cast("decimal(11,0)") + place


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


def _top(counts: DataFrame, size: int | None) -> DataFrame:
    """Most frequent first; equal counts in order of first sight, then by what is counted."""
    names = [c for c in counts.columns if c not in ("n", "first_at", "chars")]
    ordered = counts.orderBy(F.col("n").desc(), F.col("first_at"), *names)
    return ordered if size is None else ordered.limit(size)


def top_senders(rows: DataFrame, size: int = SAVED["senders"]) -> DataFrame:
    return _top(_counted(rows.select("sender", F.col("seq").alias("at")), ["sender"]), size).select("sender", "n")


def top_domains(rows: DataFrame, size: int = SAVED["domains"]) -> DataFrame:
    seen = rows.select("sender_domain", F.col("seq").alias("at"))
    return _top(_counted(seen, ["sender_domain"]), size).select("sender_domain", "n")


def _listed(rows: DataFrame, items: Column, name: str) -> DataFrame:
    seen = exploded(rows, items, name, "seq", place="place")
    return seen.select(name, _position(F.col("seq"), F.col("place")).alias("at"))


def indicator_counts(rows: DataFrame, size: int | None = None, grouped: bool = False) -> DataFrame:
    items = F.col("indicator_groups" if grouped else "indicators")
    return _top(_counted(_listed(rows, items, "indicator"), ["indicator"]), size).select("indicator", "n")


def subject_keywords(rows: DataFrame, size: int = SAVED["words"]) -> DataFrame:
    words = X.subject_words(F.coalesce("subject", F.lit("")))
    return _top(_counted(_listed(rows, words, "word"), ["word"]), size).select("word", "n")


def hour_histogram(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """All 24 hours, zero-filled; messages without a sound date are left out."""
    counts = rows.filter(F.col("hour").isNotNull()).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    n = F.coalesce("n", F.lit(0))
    return hours.join(counts, "hour", "left").select("hour", n.alias("n"), F.floor(n / 10).alias("bar"))


def report_counts(rows: DataFrame) -> DataFrame:
    """Every count of the report in one pass: one explode and one aggregate.

    Rows are ``(section, key, n, first_at, chars)``; the sections of the report are read off it.
    """
    seq = F.col("seq")
    entry = lambda s, k, at: F.struct(
        F.lit(s).alias("section"), k.alias("key"), at.cast("decimal(38,0)").alias("at")
    )
    placed = lambda s, xs: F.transform(xs, lambda x, i: entry(s, x, _position(seq, i)))
    items = F.concat(
        F.array(
            entry("kind", F.when(F.col("is_bot"), "bot").otherwise("human"), seq),
            entry("top_senders", F.col("sender"), seq),
            entry("top_domains", F.col("sender_domain"), seq),
        ),
        placed("bot_indicators", F.col("indicators")),
        placed("subject_keywords", X.subject_words(F.coalesce("subject", F.lit("")))),
        F.transform(F.array_compact(F.array(F.col("hour").cast("string"))), lambda h: entry("time_patterns", h, seq)),
    )
    chars = F.sum(F.when(F.col("section") == "kind", F.col("body_length").cast("bigint")))
    return (
        exploded(rows, items, "e", "body_length")
        .select("body_length", "e.*")
        .groupBy("section", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), chars.alias("chars"))
    )


def report_sections(counts: DataFrame) -> DataFrame:
    """The saved report as ``(section, rank, key, value)``, from stored ``report_counts``.

    Ranks are numbered over lists that a limit bounds, and over the indicators: nine labels, and one for each
    number of links that occurs.
    """
    kinds = counts.filter(F.col("section") == "kind")
    number = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    total = number(F.lit(True))
    totals = kinds.agg(
        total.alias("total_emails"),
        number(F.col("key") == "human").alias("human_emails"),
        number(F.col("key") == "bot").alias("bot_emails"),
        F.coalesce(F.try_divide(F.sum("chars"), total), F.lit(0.0)).alias("avg_length"),
    )
    distinct = lambda section: counts.filter(F.col("section") == section).agg(F.count(F.lit(1))).scalar()
    stats = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), v.cast("double").alias("value"))
                    for s, k, v in [
                        ("stats", "total_emails", F.col("total_emails")),
                        ("stats", "human_emails", F.col("human_emails")),
                        ("stats", "bot_emails", F.col("bot_emails")),
                        ("stats", "unique_senders", distinct("top_senders")),
                        ("stats", "unique_domains", distinct("top_domains")),
                        ("content_stats", "avg_length", F.col("avg_length")),
                    ]
                ]
            )
        ).alias("e")
    ).select("e.section", F.lit(None).cast("int").alias("rank"), "e.key", "e.value")
    by_rank = Window.partitionBy("section").orderBy(F.col("n").desc(), F.col("first_at"), F.col("key"))
    lists = None
    for section, size in [
        ("top_senders", SAVED["senders"]),
        ("top_domains", SAVED["domains"]),
        ("subject_keywords", SAVED["words"]),
        ("bot_indicators", None),
    ]:
        part = _top(counts.filter(F.col("section") == section), size)
        lists = part if lists is None else lists.unionByName(part)
    ranked = lists.select(
        "section", F.row_number().over(by_rank).alias("rank"), "key", F.col("n").cast("double").alias("value")
    )
    hours = counts.filter(F.col("section") == "time_patterns").select(
        "section", F.lit(None).cast("int").alias("rank"), "key", F.col("n").cast("double").alias("value")
    )
    return stats.unionByName(ranked).unionByName(hours)


def write_report(rows: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """Count once into ``path/counts``, then write and return the report from there."""
    spark = rows.sparkSession
    report_counts(rows).write.mode("overwrite").parquet(f"{path}/counts")
    report = report_sections(spark.read.parquet(f"{path}/counts"))
    schema = report.schema
    report.write.mode("overwrite").format(fmt).save(f"{path}/report")
    return spark.read.schema(schema).format(fmt).load(f"{path}/report")
