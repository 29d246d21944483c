"""Connected components of a large edge list as joins; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailgrain.llm.tables import stored


def _jump(hooks: DataFrame) -> DataFrame:
    above = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    moved = F.col("moved") | F.col("above").isNotNull()
    return hooks.join(above, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), moved.alias("moved"))


def _roots(hooks: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` (parent < node) to the end; each jump doubles the distance covered."""
    while True:
        step = stored(_jump(_jump(hooks.withColumn("moved", F.lit(False)))), "roots")
        hooks = step.select("node", "parent")
        if not step.filter("moved").limit(1).count():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b longs); root is one node per component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and keeps
    the edges between different ends. The nodes left at least halve in each round.
    """
    labels = None
    live = edges.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high")
    while True:
        hooks = live.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))
        hooks = stored(hooks, "hooks")
        if not hooks.limit(1).count():
            break
        roots = _roots(hooks)
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("root"))
        else:
            later = roots.select(F.col("node").alias("root"), F.col("parent").alias("next"))
            moved = labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = stored(moved.unionByName(later.select(F.col("root").alias("node"), F.col("next").alias("root"))), "labels")
        for end in ("low", "high"):
            to = roots.select(F.col("node").alias(end), F.col("parent").alias("to"))
            live = live.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = stored(
            live.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).filter("low < high").distinct(),
            "edges",
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    ends = labels.select(F.col("root").alias("node"), "root").distinct()
    return labels.unionByName(ends).groupBy("node").agg(F.min("root").alias("root"))
