"""An exact cooldown: of each owner's times the first, then always the first that is late enough behind the last one taken.

No owner is walked through in order by one task:

1. A time with no other within the cooldown before it is taken whatever was taken earlier, so bursts stand for themselves.
2. Within a burst every time points to the first one that is late enough behind it. Times and the moments at which each allows
   the next are sorted together within slices of an owner's time; a table with a row for each slice bridges its edges.
3. From the bursts' first times the pointers are followed by doubling: after k rounds the first ``2**k`` taken times of
   every burst are known. So the rounds grow with the logarithm of the longest burst, and there is none where no
   burst outlasts the cooldown.

Joins are on owner and time together, so an owner with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mailgrain.operators.joins import joined_null_safe
from mailgrain.session import stored

HOUR = 3_600_000_000


def _pointers(times: DataFrame, owner: list[str], wait: int, span: int) -> tuple[DataFrame, DataFrame]:
    """The bursts' first times (owner, t), and for the others' chains the pointers (owner, t, next)."""
    rows = times.select(*owner, "t", F.explode(F.array(F.lit(0), F.lit(wait))).alias("later"))
    rows = rows.withColumns({"at": F.col("t") + F.col("later"), "own": F.when(F.col("later") == 0, F.col("t"))})
    rows = rows.withColumn("slice", F.floor(F.col("at") / span))
    inside, across = Window.partitionBy(*owner, "slice"), Window.partitionBy(*owner)
    # At one moment the time itself comes before the moments that allow it.
    back = inside.orderBy(F.col("at").desc(), "later").rowsBetween(Window.unboundedPreceding, 0)
    on = inside.orderBy("at", "later").rowsBetween(Window.unboundedPreceding, -1)
    near = lambda column, window: F.last(column, ignorenulls=True).over(window)
    rows = stored(rows.withColumns({"after": near("own", back), "before": near("own", on)}).drop("own"), "moments")
    edges = rows.groupBy(*owner, "slice").agg(
        F.min(F.when(F.col("later") == 0, F.col("t"))).alias("first"), F.max(F.when(F.col("later") == 0, F.col("t"))).alias("last")
    )
    edges = edges.select(
        *owner, "slice",
        near("first", across.orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("next_first"),
        near("last", across.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("last_before"),
    )
    rows = joined_null_safe(rows, edges, [*owner, "slice"], "left")
    before = F.coalesce("before", "last_before")
    firsts = rows.filter((F.col("later") == 0) & (before.isNull() | (F.col("t") - before >= wait))).select(*owner, "t")
    firsts = stored(firsts, "firsts")
    next_one = rows.filter(F.col("later") != 0).select(*owner, "t", F.coalesce("after", "next_first").alias("next"))
    # A burst's first time is taken anyway; no chain goes on into another burst.
    ahead = firsts.select(*owner, F.col("t").alias("next"))
    return firsts, joined_null_safe(next_one.filter("next IS NOT NULL"), ahead, [*owner, "next"], "left_anti")


def taken(times: DataFrame, owner: list[str], wait: int, span: int = HOUR) -> DataFrame:
    """Which of the distinct times (``owner`` columns, ``t`` in microseconds) are taken; ``wait`` and the slices' ``span`` likewise."""
    firsts, pointers = _pointers(times, owner, wait, span)
    found, pointers = firsts, stored(pointers, "pointers")
    while not pointers.isEmpty():
        reached = joined_null_safe(found, pointers, [*owner, "t"]).select(*owner, F.col("next").alias("t"))
        found = stored(found.unionByName(reached), "taken")
        further = pointers.select(*owner, F.col("t").alias("next"), F.col("next").alias("far"))
        pointers = stored(joined_null_safe(pointers, further, [*owner, "next"]).select(*owner, "t", F.col("far").alias("next")), "pointers")
    return found
