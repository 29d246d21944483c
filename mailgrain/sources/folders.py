"""Tables of many folders, of which a manifest names the live ones.

A writer puts new folders beside the old ones and then switches by one small file, so that a reader sees all of a
change or nothing of it, and a writer lost in between leaves nothing but folders no manifest names. There is one
writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing, if there is none."""
    place, files = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    place, files = _at(spark, path)
    files.delete(place, True)


def read(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    """The rows of some folders; no rows, if there are none."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Live:
    """Numbers by name, such as the generation that holds a folder. ``version`` counts the switches."""

    version: int = 0
    numbers: dict[str, int] = field(default_factory=dict)


def newest(spark: SparkSession, path: str) -> Live:
    versions = [int(n.removeprefix("version=")) for n in names(spark, f"{path}/live") if n.startswith("version=")]
    for version in sorted(versions, reverse=True):
        folder = f"{path}/live/version={version}"
        if "_SUCCESS" in names(spark, folder):  # else its writer was lost
            rows = spark.read.schema("name string, number long").parquet(folder).collect()
            return Live(version, {r["name"]: r["number"] for r in rows})
    return Live()


def switch(spark: SparkSession, path: str, now: Live) -> None:
    """Make ``now`` the newest manifest. The one before it stays, for readers that have just begun."""
    rows = spark.createDataFrame(sorted(now.numbers.items()), "name string, number long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/live/version={now.version}")
    for name in names(spark, f"{path}/live"):
        if name.startswith("version=") and int(name.removeprefix("version=")) < now.version - 1:
            delete(spark, f"{path}/live/{name}")
