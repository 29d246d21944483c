"""Named queries over the test tables, each with plain SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailgrain.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


def iso(time: Column | str) -> Column:
    """Times as text, so that results compare alike whatever the reader's zone."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(items: Column | str) -> Column:
    """Lists as text, likewise."""
    return F.array_join(items, "|")
