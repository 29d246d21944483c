"""Bot classifiers with explainable weights, and the decisions that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.functions import features as X
from mailgrain.functions.text import found, has, has_any, labelled, let
from mailgrain.operators.joins import copied_join, identity, salted_join
from mailgrain.session import stored

# Default weights of the two weighted classifiers, in the order they are checked.
RATIO_WEIGHTS = {
    "headers": {
        "list-unsubscribe": 0.8,
        "precedence: bulk": 0.9,
        "x-marketing": 0.85,
        "x-campaign": 0.85,
        "x-mailer": 0.7,
        "auto-submitted": 0.9,
        "x-autoreply": 0.8,
    },
    "keywords": {
        "unsubscribe": 0.7,
        "newsletter": 0.8,
        "marketing": 0.75,
        "subscription": 0.7,
        "loan": 0.9,
        "mortgage": 0.9,
        "credit": 0.9,
        "promotion": 0.8,
        "special offer": 0.8,
        "click here": 0.7,
    },
    "patterns": {"link": 0.6, "phone": 0.5, "price": 0.5},
}
MEAN_WEIGHTS = {
    "headers": {"x-pm-content-encryption": 0.8, "x-pm-origin": 0.7, "x-pm-transfer-encoding": 0.6},
    "keywords": {
        "unsubscribe": 0.9,
        "click here": 0.8,
        "view in browser": 0.7,
        "marketing": 0.8,
        "newsletter": 0.7,
    },
    "patterns": {"link": 0.7, "square_brackets": 0.6, "curly_brackets": 0.6},
}
# What the named body patterns match. Searches only ask whether there is a match.
BODY_PATTERNS = {
    "link": X.LINK,
    "phone": r"[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "price": r"\$\p{Nd}",
    "square_brackets": r"\[[^\]\n]*\]",
    "curly_brackets": r"\{[^}\n]*\}",
}
# A character every match of the pattern holds; without it the pattern need not be tried.
NEEDED = {"link": ":", "phone": "-", "price": "$", "square_brackets": "[", "curly_brackets": "{"}
# Phrases, senders and weights of the additive classifier.
ADDITIVE_PHRASES = ["unsubscribe", "click here", "special offer", "limited time"]
AUTOMATED_SENDERS = ["noreply", "no-reply", "donotreply", "auto@"]
MANY_URLS = 5
# Categories of weights that classifiers read.
READ_CATEGORIES = ["headers", "keywords", "patterns"]
# Thresholds between low, uncertain and high confidence.
LOW, HIGH = 0.3, 0.7
# Importance and unsubscribe words.
IMPORTANT_WORDS = ["urgent", "meeting"]
SPAM_WORDS = ["loan", "mortgage", "credit"]


def any_case(headers: Column, name: str) -> Column:
    """The value of a header whatever the case of its name; of several the first."""
    fitting = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(fitting, 0)["value"]


def shows(body: Column, name: str) -> Column:
    """Whether a body pattern matches; never NULL. A name that is not known is an expression itself."""
    if name not in BODY_PATTERNS:
        return found(body, name)
    return has(body, NEEDED[name]) & found(body, BODY_PATTERNS[name])


def with_lowered(mail: DataFrame) -> DataFrame:
    """Header names and body in lower case, computed once for all the tests that follow."""
    return mail.select(
        "*",
        F.lower(F.coalesce("body_text", F.lit(""))).alias("_low"),
        F.coalesce(F.transform(F.map_keys("headers"), F.lower), F.array().cast("array<string>")).alias("_names"),
    )


def weighted_hits(weights: dict, any_case: bool) -> list[tuple[str, str, float, Column]]:
    """Each weight with its test, in check order; header names are compared whole."""
    tests = []
    names = F.col("_names") if any_case else F.map_keys("headers")
    for name, weight in weights["headers"].items():
        tests.append(("headers", name, weight, F.coalesce(F.array_contains(names, name), F.lit(False))))
    for phrase, weight in weights["keywords"].items():
        tests.append(("keywords", phrase, weight, has(F.col("_low"), phrase)))
    for name, weight in weights["patterns"].items():
        tests.append(("patterns", name, weight, shows(F.col("body_text"), name)))
    return tests


def ratio_score(any_hit: Column, body: Column) -> Column:
    """Matched weights over themselves: 1 on any hit, else 0, and a little more for long bodies."""
    base = F.when(any_hit, 1.0).otherwise(0.0)
    return F.least(base + F.when(F.length(body) > 1000, 0.1).otherwise(0.0), F.lit(1.0))


def classify_ratio(mail: DataFrame, weights: dict = RATIO_WEIGHTS) -> DataFrame:
    any_hit = F.lit(False)
    for _, _, _, hit in weighted_hits(weights, any_case=True):
        any_hit = any_hit | hit
    scored = with_lowered(mail).withColumn("score", ratio_score(any_hit, F.col("body_text")))
    return scored.withColumn("is_bot", F.col("score") > 0.5).drop("_low", "_names")


def classify_mean(mail: DataFrame, weights: dict = MEAN_WEIGHTS) -> DataFrame:
    """Mean of the matched weights, added up in check order."""
    total, hits = F.lit(0.0), F.lit(0)
    for _, _, weight, hit in weighted_hits(weights, any_case=False):
        total = total + F.when(hit, weight).otherwise(0.0)
        hits = hits + hit.cast("int")
    summed = with_lowered(mail).select("*", total.alias("_total"), hits.alias("_hits"))
    scored = summed.withColumn("score", F.coalesce(F.try_divide("_total", "_hits"), F.lit(0.0)))
    return scored.withColumn("is_bot", F.col("score") > 0.5).drop("_low", "_names", "_total", "_hits")


def explain_weights(mail: DataFrame, weights: dict = RATIO_WEIGHTS) -> DataFrame:
    """The matched weights of each message, in check order."""
    entries = [
        F.when(hit, F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"), F.lit(w).alias("weight")))
        for c, p, w, hit in weighted_hits(weights, any_case=True)
    ]
    matched = F.array_compact(F.array(*entries))
    return with_lowered(mail).withColumn("matched", matched).drop("_low", "_names")


def classify_additive(mail: DataFrame) -> DataFrame:
    """Sum of indicator weights; the score is capped, the flag tests the sum before the cap.

    Adds ``score``, ``is_bot``, ``indicators`` (labels in check order, the link label holding its
    count) and ``indicator_groups`` (the same with one label for many links).
    """
    base = with_lowered(mail).withColumn("_urls", F.coalesce(X.url_count(F.col("body_text")), F.lit(0)))
    headers, low = F.col("headers"), F.col("_low")
    campaign = F.exists(
        "_names", lambda n: F.startswith(n, F.lit("x-marketing")) | F.startswith(n, F.lit("x-campaign"))
    )
    bulk = has(F.lower(any_case(headers, "precedence")), "bulk")
    checks = [
        (F.array_contains("_names", "list-unsubscribe"), "list-unsubscribe", 0.8),
        (bulk, "precedence: bulk", 0.9),
        (campaign, "marketing headers", 0.85),
        (F.array_contains("_names", "auto-submitted"), "auto-submitted", 0.9),
        (has_any(F.lower("sender"), AUTOMATED_SENDERS), "noreply sender", 0.85),
    ]
    total = F.lit(0.0)
    for hit, _, weight in checks:
        total = total + F.when(hit, weight).otherwise(0.0)
    phrases = labelled(*[(has(low, p), p) for p in ADDITIVE_PHRASES])
    many = F.col("_urls") > MANY_URLS
    total = total + F.size("_phrases") * F.lit(0.3) + F.when(many, 0.5).otherwise(0.0)
    urls = F.concat(F.col("_urls").cast("string"), F.lit(" URLs"))
    first = labelled(*[(hit, label) for hit, label, _ in checks])
    return (
        base.withColumn("_phrases", phrases)
        .select(
            "*",
            total.alias("_total"),
            F.concat(first, F.col("_phrases"), labelled((many, urls))).alias("indicators"),
            F.concat(first, F.col("_phrases"), labelled((many, "many_urls"))).alias("indicator_groups"),
        )
        .withColumn("score", F.least("_total", F.lit(1.0)))
        .withColumn("is_bot", F.col("_total") > 0.5)
        .drop("_low", "_names", "_urls", "_phrases", "_total")
    )


def confidence_band(score: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(score < low, "low").when(score < high, "uncertain").otherwise("high")


def tested_patterns(weights: DataFrame) -> dict[str, list[str]]:
    """The keywords and expressions of a weight table, in order; read by one small job."""
    tested = weights.filter(F.col("category").isin("keywords", "patterns")).select("category", "pattern").distinct()
    tests = {"keywords": [], "patterns": []}
    for row in tested.orderBy("category", "pattern").toLocalIterator():
        tests[row["category"]].append(row["pattern"])
    return tests


def _entry(tag: Column, weight: Column, ratio: bool, mean: bool) -> Column:
    """One weight and the scores it counts for, under its ``category:pattern``."""
    return F.struct(tag.alias("tag"), weight.alias("weight"), F.lit(ratio).alias("ratio"), F.lit(mean).alias("mean"))


def header_weights(names: DataFrame, weights: DataFrame) -> DataFrame:
    """``names, known`` for every distinct list of header names: the weights that the list shows.

    Header names count in lower case for the ratio and as written for the mean. Mail has few lists of names, so
    each is looked up once, not once a message; names such as ``from`` sit in every list, so each weight is copied.
    """
    lists = names.select("names").distinct()
    marked = lambda n, ratio: F.struct(n.alias("pattern"), F.lit(ratio).alias("ratio"), F.lit(not ratio).alias("mean"))
    lowered = F.transform(F.array_distinct(F.transform("names", F.lower)), lambda n: marked(n, True))
    each = lists.select("names", F.explode(F.concat(lowered, F.transform("names", lambda n: marked(n, False)))).alias("h"))
    table = weights.filter("category = 'headers' AND weight IS NOT NULL").select("pattern", "weight")
    found = copied_join(each.select("names", "h.*"), table, ["pattern"], F.xxhash64("names"))
    tag = F.concat(F.lit("headers:"), "pattern")
    return found.groupBy("names").agg(F.collect_list(F.struct(tag.alias("tag"), "weight", "ratio", "mean")).alias("known"))


def classify_learned(mail: DataFrame, weights: DataFrame) -> DataFrame:
    """Both weighted classifiers with a weight table instead of fixed weights.

    Returns the message's identity, ``hits``, ``ratio_score``, ``ratio_bot``, ``mean_score``, ``mean_bot``.
    Keywords and expressions are those of the table, whatever was learned or added; each is tested in place, so
    they are read first with their weights, by one small job. Header names are unbounded and looked up by lists of names; a
    list that a third of all mail has is spread in the join. A message's weights are added in a fixed order, and their
    number is bounded by the message.
    """
    table = stored(weights.filter(F.col("category").isin(READ_CATEGORIES)).select("category", "pattern", "weight"), "weights")
    keys = identity(mail)
    tests = {"keywords": lambda k: has(F.col("_low"), k), "patterns": lambda p: shows(F.col("body_text"), p)}
    tested = table.filter(F.col("category").isin(*tests) & F.col("weight").isNotNull()).orderBy("category", "pattern", "weight")
    shown = [
        F.when(tests[r["category"]](r["pattern"]), _entry(F.lit(f"{r['category']}:{r['pattern']}"), F.lit(r["weight"]), True, True))
        for r in tested.toLocalIterator()
    ]
    none = F.filter(F.array(_entry(F.lit(""), F.lit(0.0), False, False)), lambda _: F.lit(False))
    rows = with_lowered(mail).select(
        *keys,
        F.array_sort(F.coalesce(F.map_keys("headers"), F.array().cast("array<string>"))).alias("names"),
        (F.length("body_text") > 1000).alias("_long"),
        (F.array_compact(F.array(*shown)) if shown else none).alias("_shown"),
    )
    joined = salted_join(rows, header_weights(rows, table), ["names"], F.xxhash64(*keys), "left")
    joined = joined.withColumn("w", F.array_sort(F.concat(F.coalesce("known", none), "_shown")))
    of = lambda kind: F.filter("w", lambda x: x[kind])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x["weight"])
    bonus = F.when(F.col("_long"), 0.1).otherwise(0.0)
    ratio = F.when(total(of("ratio")) > 0, 1.0).otherwise(0.0)
    return (
        joined.select(
            *keys,
            F.size(of("ratio")).alias("hits"),
            F.least(ratio + bonus, F.lit(1.0)).alias("ratio_score"),
            let(of("mean"), lambda xs: F.coalesce(F.try_divide(total(xs), F.size(xs)), F.lit(0.0))).alias("mean_score"),
        )
        .withColumn("ratio_bot", F.col("ratio_score") > 0.5)
        .withColumn("mean_bot", F.col("mean_score") > 0.5)
    )


def flag_importance(mail: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Important by known sender, by word, or by being part of a reply chain of its account.

    ``whitelist`` has one column, ``sender``. Thread sizes are counted before they are joined, and
    both joins spread hot keys, for a sender or thread may hold much of the mailbox. Mail is read once, for narrow rows
    that are stored; threads and hot keys are counted on those.
    """
    keys = identity(mail)
    thread = [k for k in keys if k != "message_id"] + ["thread_id"]
    words = F.lower(F.concat_ws(" ", "subject", "body_text"))
    marked = stored(mail.select(*keys, "thread_id", "sender", has_any(words, IMPORTANT_WORDS).alias("has_word")), "marked")
    threads = marked.groupBy(*thread).agg((F.count(F.lit(1)) > 1).alias("in_chain"))
    known = whitelist.select("sender").distinct().withColumn("known_sender", F.lit(True))
    spread = F.xxhash64(*keys)
    joined = copied_join(marked, known, ["sender"], spread, "left")
    joined = salted_join(joined, threads, thread, spread, "left")
    known_sender = F.coalesce("known_sender", F.lit(False))
    in_chain = F.coalesce("in_chain", F.lit(False))
    return joined.select(
        *keys,
        known_sender.alias("known_sender"),
        "has_word",
        in_chain.alias("in_chain"),
        (known_sender | F.col("has_word") | in_chain).alias("is_important"),
    )


def unsubscribe_targets(classified: DataFrame) -> DataFrame:
    """Work list of unsubscribe links for bot mail and spam; nothing is sent."""
    spam = has_any(F.lower("body_text"), SPAM_WORDS)
    header = any_case(F.col("headers"), "list-unsubscribe")
    targets = F.regexp_extract_all(header, F.lit(r"<([^<>]+)>"), F.lit(1))
    return (
        classified.filter((F.col("is_bot") | spam) & header.isNotNull())
        .select(*identity(classified), "sender", F.explode(targets).alias("target"))
        .withColumn("method", F.when(F.startswith("target", F.lit("mailto:")), "mail").otherwise("web"))
    )
