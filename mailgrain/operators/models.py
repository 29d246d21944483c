"""Training samples, model metrics and feature scores; nothing is trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.functions import features as X
from mailgrain.operators.classify import classify_additive
from mailgrain.operators.joins import identity


def feature_map() -> Column:
    """Numeric features of a message by name; needs the additive classifier's columns."""
    body, subject = F.col("body_text"), F.lower("subject")
    values = {
        "score": F.col("score"),
        "body_length": F.length(body),
        "line_length": X.mean_line_length(body),
        "url_count": X.url_count(body),
        "hour": X.hour_received(F.col("date_received")),
        "indicators": F.size("indicators"),
        "recipients": F.size("recipients"),
        "has_attachment": F.col("has_attachment").cast("int"),
        "is_reply": F.contains(subject, F.lit("re:")).cast("int"),
        "has_signature": X.signature_marker(body).cast("int"),
    }
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("double"))]
    return F.create_map(*pairs)


def build_training_set(mail: DataFrame, feedback: DataFrame) -> DataFrame:
    """Features of all mail with the user's label where there is one; a label makes a row validated.

    ``feedback``: the message's identity, priority, category, unique per message.
    """
    scored, keys = classify_additive(mail), identity(mail)
    features = scored.select(
        *keys,
        feature_map().alias("features"),
        F.col("score").alias("confidence"),
        F.col("date_received").alias("created_at"),
    )
    return features.join(feedback, identity(feedback), "left").select(
        *keys,
        "features",
        F.col("priority").alias("label_priority"),
        F.col("category").alias("label_category"),
        "confidence",
        F.col("priority").isNotNull().alias("is_validated"),
        "created_at",
    )


def validated_training(samples: DataFrame, size: int | None = None) -> DataFrame:
    """Validated samples, newest first; no size, or zero, means all."""
    rows = samples.filter("is_validated").orderBy(F.col("created_at").desc(), *identity(samples))
    rows = rows.limit(size) if size else rows
    return rows.select(*identity(samples), "features", "label_priority", "label_category")


def model_metrics(judged: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class, with accuracy over all, from ``label`` and ``predicted``.

    Rows shrink to the confusion counts in one aggregate; the rest works on those few.
    """
    cells = judged.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("label") == F.col("predicted")
    right = F.when(same, F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("named"),
                         right.alias("hits")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).alias("support"), F.col("n").alias("named"),
                         F.lit(0).alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("named").alias("named"), F.sum("hits").alias("hits")
    )
    accuracy = cells.agg(F.try_divide(F.sum(right), F.sum("n"))).scalar()
    samples = cells.agg(F.sum("n")).scalar()
    return per_class.select(
        "class",
        F.try_divide("hits", "named").alias("precision"),
        F.try_divide("hits", "support").alias("recall"),
        F.try_divide(F.col("hits") * 2, F.col("named") + F.col("support")).alias("f1"),
        "support",
        accuracy.alias("accuracy"),
        samples.alias("samples"),
    )


def feature_importance_top(scores: DataFrame, versions: DataFrame, size: int | None = None) -> DataFrame:
    """Features of the active model, best first. ``scores``: version, feature_name, importance_score."""
    active = versions.filter("is_active").select("version").distinct()
    ranked = scores.join(active, "version", "left_semi")
    ordered = ranked.orderBy(F.col("importance_score").desc(), F.col("feature_name"))
    return ordered if size is None else ordered.limit(size)
