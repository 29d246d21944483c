"""Mailbox state as a fold over the action log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailgrain.operators.joins import copied_join, identity

# The label a trashed or archived message carries here.
TRASH, ARCHIVED = "TRASH", "ARCHIVED"


def label_ops(actions: DataFrame, known_labels: DataFrame) -> DataFrame:
    """Each action as label changes: the message's identity, label, added, ts, seq.

    ``actions``: the message's identity, action_type, action_value, ts, seq. ``known_labels``: name, and the account that
    knows it where accounts differ. A move adds the label of the message's account whose name matches in any case and leaves
    others alone; a move to an unknown label, and any other action, changes nothing.
    """
    kind, keys = F.col("action_type"), identity(actions)
    scope = [k for k in keys if k in known_labels.columns]
    names = known_labels.select(*scope, F.col("name").alias("_known"), F.lower("name").alias("_key")).dropDuplicates([*scope, "_key"])
    target = F.when(kind == "move", F.lower("action_value"))
    label = (
        F.when(kind == "read", "UNREAD")
        .when(kind.isin("star", "unstar"), "STARRED")
        .when(kind == "delete", TRASH)
        .when(kind == "archive", ARCHIVED)
    )
    fixed = actions.filter(kind != "move").select(
        *keys, label.alias("label"), (~kind.isin("read", "unstar")).alias("added"), "ts", "seq"
    )
    # One row per message and target before the lookup: only the last move to a label matters.
    # All moves share a few labels, so the lookup is copied and no label's moves meet in one task.
    targets = (
        actions.filter(kind == "move")
        .groupBy(*keys, target.alias("_key"))
        .agg(F.max(F.struct("ts", "seq")).alias("at"))
    )
    moves = copied_join(targets, names, [*scope, "_key"], F.xxhash64(*keys)).select(
        *keys, F.col("_known").alias("label"), F.lit(True).alias("added"), "at.ts", "at.seq"
    )
    return fixed.filter(F.col("label").isNotNull()).unionByName(moves)


def initial_ops(mail: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Labels a message came with, as additions before any action."""
    return mail.select(
        *(keys or identity(mail)),
        F.explode("labels").alias("label"),
        F.lit(True).alias("added"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.lit(-1).cast("bigint").alias("seq"),
    )


def last_ops(ops: DataFrame) -> DataFrame:
    """The last change per message and label. Taking the larger ``(ts, seq)`` is commutative and
    idempotent, so batches may come late, twice or in any order."""
    last = F.max(F.struct("ts", "seq", "added"))
    keys = identity(ops)
    return ops.groupBy(*keys, "label").agg(last.alias("op")).select(*keys, "label", "op.*")


def state_of(last: DataFrame) -> DataFrame:
    """Label set per message; a message has at most as many as its account has labels."""
    held = F.array_sort(F.collect_set(F.when(F.col("added"), F.col("label"))))
    folded = last.groupBy(*identity(last)).agg(held.alias("labels"))
    return folded.withColumn("is_archived", F.array_contains("labels", ARCHIVED))


def action_state(mail: DataFrame, actions: DataFrame, known_labels: DataFrame) -> DataFrame:
    """The labels of all mail after the actions, which are told apart by the identity columns that they have."""
    ops = initial_ops(mail, identity(actions)).unionByName(label_ops(actions, known_labels))
    return state_of(last_ops(ops))


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy(*identity(actions), "action_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at")
    )
