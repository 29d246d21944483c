"""Joins and picks that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hot_keys(rows: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Keys with at least ``share`` of all rows; there can be no more than ``1 / share`` of them."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") >= total * F.lit(share)).select(*keys)


def salted_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Equi-join in which hot keys of ``big`` are spread over ``salts`` partitions.

    Only the hot keys of ``lookup`` are copied, and their number is bounded by ``1 / share``, so
    both the broadcast set and the copies have a proven size. Keys that are NULL match nothing and
    are spread as well. ``how`` is ``inner`` or ``left``.
    """
    hot = F.broadcast(hot_keys(big, keys, share).withColumn("_hot", F.lit(True)))
    empty_key = F.lit(False)
    for key in keys:
        empty_key = empty_key | F.col(key).isNull()
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    spread_rows = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | empty_key, salt).otherwise(F.lit(0))
    )
    copies = lookup.join(hot, keys, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return spread_rows.drop("_hot").join(copies.drop("_hot"), [*keys, "_salt"], how).drop("_salt")


def copied_join(
    big: DataFrame, lookup: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join with a lookup far smaller than ``big``: every lookup row is copied ``salts`` times.

    No counting pass is needed, so ``big`` is computed once; any key is spread over ``salts``
    partitions. Spark broadcasts the copies only while they stay under its size threshold.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def joined_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls are equal; the keys are those of ``a``."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, same, how).drop(*(f"_{k}" for k in keys))


#: What tells messages apart; ids and threads are unique within an account only.
IDENTITY = ["provider", "account", "message_id"]


def identity(rows: DataFrame) -> list[str]:
    """The identity columns that a table has; one without provider or account holds one mailbox."""
    return [c for c in IDENTITY if c in rows.columns]


def pick_per_key(rows: DataFrame, keys: list[str], order: list[str], latest: bool) -> DataFrame:
    """Whole rows that come first or last in ``order`` for their key; ``order`` must tell a key's rows apart.

    Only keys and order are aggregated, partly before the shuffle. The rows are then fetched by both
    together, so a key with a third of all rows loads no single task.
    """
    end = F.max if latest else F.min
    wanted = rows.groupBy(*keys).agg(end(F.struct(*order)).alias("_end"))
    wanted = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(f"_end.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    same = F.lit(True)
    for i, name in enumerate(keys):
        same = same & F.col(name).eqNullSafe(F.col(f"_k{i}"))
    for i, name in enumerate(order):
        same = same & F.col(name).eqNullSafe(F.col(f"_o{i}"))
    return rows.join(wanted, same, "left_semi")
