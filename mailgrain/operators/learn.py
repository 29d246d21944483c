"""Learning weights from history: one explode, one aggregate, then arithmetic on the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailgrain import schemas
from mailgrain.functions import features as X
from mailgrain.functions.text import exploded, has
from mailgrain.operators.classify import RATIO_WEIGHTS, shows, tested_patterns, with_lowered
from mailgrain.sources.mailstore import folders_between

# Weight per unit of frequency, for each category of patterns.
MULTIPLIERS = {
    "headers": 2.0,
    "keywords": 2.0,
    "patterns": 2.0,
    "sender_patterns": 3.0,
    "subject_patterns": 2.0,
    "time_patterns": 2.0,
    "length_patterns": 1.5,
    "link_patterns": 2.0,
    "domain_patterns": 2.0,
    "content_patterns": 2.5,
    "reply_patterns": 0.5,
    "attachment_patterns": 0.3,
    "spacing_patterns": 1.5,
    "signature_patterns": 0.4,
}
# Categories of which only some patterns become weights.
KEPT_PATTERNS = {
    "time_patterns": ["0", "1", "2", "3", "4", "5", "23"],
    "length_patterns": ["short", "long"],
    "link_patterns": ["many"],
    "spacing_patterns": ["dense"],
}
# Pattern expressions as weights files spell them, and their names.
SAVED_EXPRESSIONS = {
    r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+": "link",
    r"[0-9]{3}-[0-9]{3}-[0-9]{4}": "phone",
    r"\$\d+\.?\d*": "price",
    r"\[.*?\]": "square_brackets",
    r"\{.*?\}": "curly_brackets",
}
# Fixed value: the single multiplier of the flat provider.
FLAT_MULTIPLIER = 2.0


def in_window(mail: DataFrame, as_of: Column, months_back: int = 24) -> DataFrame:
    """Mail of the last ``months_back`` months of 30 days; ``as_of`` is an input, never the clock. Of a
    date-partitioned table only the window's folders are read."""
    start = as_of - F.make_dt_interval(days=F.lit(30 * months_back))
    return folders_between(mail, start, as_of).filter((F.col("date_received") >= start) & (F.col("date_received") <= as_of))


def _tag(category: str, pattern: Column | str) -> Column:
    """A category and pattern as one text, the key that is shuffled."""
    return F.lit(f"{category}:{pattern}") if isinstance(pattern, str) else F.concat(F.lit(f"{category}:"), pattern)


def _tags(category: str, tests: list[tuple[Column, str]]) -> list[Column]:
    return [F.when(hit, _tag(category, name)) for hit, name in tests]


def _count(rows: DataFrame, tags: Column) -> DataFrame:
    counts = exploded(rows, tags, "tag").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        F.substring_index("tag", ":", 1).alias("category"),
        F.expr("substring(tag, instr(tag, ':') + 1)").alias("pattern"),
        "n",
    )


def pattern_counts(mail: DataFrame, zone: str = "UTC", weights: DataFrame | None = None) -> DataFrame:
    """How many messages show each pattern, over fourteen categories.

    Keywords and expressions are those of the table ``weights``, whatever was learned or added; by default the
    fixed ones.
    """
    body, low, links = F.col("body_text"), F.col("_low"), F.col("_links")
    tests = RATIO_WEIGHTS if weights is None else tested_patterns(weights)
    tags = [
        *_tags("keywords", [(has(low, k), k) for k in tests["keywords"]]),
        *_tags("patterns", [(links > 0 if p == "link" else shows(body, p), p) for p in tests["patterns"]]),
        _tag("sender_patterns", X.sender_name(F.col("sender"))),
        *_tags("subject_patterns", X.subject_tests(F.col("_subject"))),
        _tag("time_patterns", X.hour_received(F.col("date_received"), zone).cast("string")),
        _tag("length_patterns", X.length_bucket(F.col("_size"))),
        _tag("link_patterns", X.link_bucket(links)),
        _tag("domain_patterns", X.sender_domain_learn(F.col("sender"))),
        *_tags("content_patterns", X.content_tests(low)),
        *_tags("reply_patterns", X.reply_tests(body)),
        *_tags("attachment_patterns", [(F.col("has_attachment"), "has_attachment")]),
        _tag("spacing_patterns", X.spacing_bucket(F.col("_line"))),
        *_tags("signature_patterns", [(X.signature_marker(body), "has_signature")]),
    ]
    headers = F.transform(F.array_distinct("_names"), lambda n: _tag("headers", n))
    # What is tested more than once is computed once, below the explode.
    rows = with_lowered(mail).withColumns(
        {
            "_links": X.link_count(body),
            "_size": F.length(body),
            "_line": X.mean_line_length(body),
            "_subject": F.lower("subject"),
        }
    )
    return _count(rows, F.concat(headers, F.array(*tags)))


def pattern_counts_flat(mail: DataFrame) -> DataFrame:
    """The flat provider's counts: sender domains and one phrase."""
    tags = [
        _tag("domain_patterns", X.sender_domain_learn(F.col("sender"))),
        *_tags("content_patterns", [(has(F.lower("body_text"), "unsubscribe"), "unsubscribe")]),
    ]
    return _count(mail, F.array(*tags))


def learn_weights(
    counts: DataFrame, mail: DataFrame, exclude_headers: list[str] | None = None
) -> DataFrame:
    """Counts to weights: share of messages times the category's multiplier, at most 1.

    Some categories keep only telling patterns. ``exclude_headers`` leaves out header names that
    sit in all mail; by default none is left out.
    """
    total = mail.agg(F.count(F.lit(1))).scalar()
    factor, kept = F.lit(None).cast("double"), F.lit(True)
    for category, value in MULTIPLIERS.items():
        factor = F.when(F.col("category") == category, value).otherwise(factor)
    for category, patterns in KEPT_PATTERNS.items():
        kept = kept & ((F.col("category") != category) | F.col("pattern").isin(patterns))
    if exclude_headers:
        kept = kept & ~((F.col("category") == "headers") & F.col("pattern").isin(exclude_headers))
    share = F.col("n") / total
    return counts.filter(kept).select("category", "pattern", F.least(F.lit(1.0), share * factor).alias("weight"))


def learn_weights_flat(counts: DataFrame, mail: DataFrame) -> DataFrame:
    total = mail.agg(F.count(F.lit(1))).scalar()
    weight = F.least(F.lit(1.0), F.col("n") / total * F.lit(FLAT_MULTIPLIER))
    return counts.select("category", "pattern", weight.alias("weight"))


def default_weights(spark: SparkSession, weights: dict = RATIO_WEIGHTS) -> DataFrame:
    rows = [(c, p, float(w)) for c, table in weights.items() for p, w in table.items()]
    return spark.createDataFrame(rows, "category string, pattern string, weight double")


def overlay(current: DataFrame, learned: DataFrame, emptied: list[str] | None = None) -> DataFrame:
    """Learned categories replace current ones as a whole; others stay.

    ``emptied`` names categories that were learned without any pattern and so vanish too. The flat
    provider learns all fourteen in this way; leaving it out merges only categories with content.
    """
    replaced = learned.select("category").distinct()
    kept = current.join(replaced, "category", "left_anti")
    if emptied:
        kept = kept.filter(~F.col("category").isin(emptied))
    return kept.unionByName(learned.select("category", "pattern", "weight"))


def save_weights(weights: DataFrame, path: str, provider: str, account: str, version: int) -> None:
    """Append one version of the weight table; re-running a version replaces just that version."""
    keys = {"provider": provider, "account": account, "version": version}
    folder = f"{path}/" + "/".join(f"{name}={value}" for name, value in keys.items())
    weights.select("category", "pattern", "weight").write.mode("overwrite").parquet(folder)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WEIGHT).option("basePath", path).parquet(path)


def load_weights(defaults: DataFrame, saved: DataFrame, provider: str, account: str) -> DataFrame:
    """Defaults overlaid with the newest saved version of one account; no version keeps defaults."""
    mine = saved.filter((F.col("provider") == provider) & (F.col("account") == account))
    newest = mine.agg(F.max("version")).scalar()
    return overlay(defaults, mine.filter(F.col("version") == newest))


def write_weights_lines(weights: DataFrame, path: str, saved_at: Column) -> None:
    """Weights as JSON lines, one per pattern, with the time and the format version of saving."""
    lines = weights.select("category", "pattern", "weight", saved_at.alias("last_updated"), F.lit("1.0").alias("version"))
    lines.write.mode("overwrite").json(path)


def read_weights_document(spark: SparkSession, path: str) -> DataFrame:
    """A weights file as older tools saved it, one JSON document of categories under ``weights``.

    A category is an object of weights by pattern, or a list of pattern and weight pairs. Known
    expressions get the names they go by here; others keep their text.
    """
    document = spark.read.schema("weights map<string,string>").option("multiLine", True).json(path)
    category = document.select(F.explode("weights").alias("category", "text"))
    by_object = F.map_entries(F.from_json("text", "map<string,double>"))
    by_pair = F.transform(
        F.from_json("text", "array<array<string>>"),
        lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 1).try_cast("double").alias("value")),
    )
    entries = F.when(F.startswith(F.ltrim("text"), F.lit("[")), by_pair).otherwise(by_object)
    rows = exploded(category, entries, "e", "category")
    name = F.col("e.key")
    for expression, known in SAVED_EXPRESSIONS.items():
        name = F.when(F.col("e.key") == expression, known).otherwise(name)
    return rows.select("category", name.alias("pattern"), F.col("e.value").alias("weight"))
