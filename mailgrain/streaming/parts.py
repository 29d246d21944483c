"""Mergeable parts of a stream, and their merging in generations, so that the number of folders stays bounded.

Every micro-batch stores one part under its id. Of each ``FAN`` neighbouring parts of a level one part of the next level is
made: part k of level l holds the batches from ``k * FAN**l`` on. A manifest counts the finished parts of each level, and by it a
reader takes every batch from exactly one live part. So

- a row is written again once for each level, that is, with the logarithm of the number of batches,
- a writer lost between merging and switching leaves a folder that no manifest counts and the next one writes anew,
- a batch that comes again after its part was merged writes a part that is not read,
- folders are deleted one switch after they were replaced, for readers that have begun with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mailgrain.sources import folders
from mailgrain.sources.folders import Live

FAN = 16
Merge = Callable[[DataFrame], DataFrame]


def part_path(path: str, level: int, number: int) -> str:
    return f"{path}/parts/batch={number}" if level == 0 else f"{path}/merged/level={level}/part={number}"


def _count(live: Live, level: int) -> int:
    return live.numbers.get(f"level={level}", 0)


def _there(spark: SparkSession, path: str, level: int) -> list[int]:
    inside = folders.names(spark, f"{path}/parts" if level == 0 else f"{path}/merged/level={level}")
    return sorted(int(n.split("=")[1]) for n in inside if "=" in n)


def live_parts(spark: SparkSession, path: str, before: int | None = None, fan: int = FAN) -> list[str]:
    """The folders to read: all parts that are not merged into a higher one; only batches ``before`` an id if it is given."""
    live, out = folders.newest(spark, path), []
    levels = max((int(n.removeprefix("level=")) for n in live.numbers), default=0)
    for level in range(levels, -1, -1):
        first, end = _count(live, level + 1) * fan, _count(live, level) if level else None
        for number in _there(spark, path, level):
            if number >= first and (end is None or number < end) and (level or before is None or number < before):
                out.append(part_path(path, level, number))
    return out


def write_part(part: DataFrame, folder: str, by: list[str] | None = None) -> None:
    part.write.mode("overwrite").partitionBy(*(by or [])).parquet(folder)


def read_folders(spark: SparkSession, path: str, paths: list[str], by: list[str] | None = None) -> DataFrame:
    """The rows of parts, without the columns ``by`` that name their inner folders. The empty part that a stream begins with
    gives the other columns."""
    schema = spark.read.parquet(part_path(path, 0, -1)).schema
    if by:
        paths = [f"{p}/{n}" for p in paths for n in folders.names(spark, p) if n.startswith(f"{by[0]}=")]
    return folders.read(spark, StructType([f for f in schema if f.name not in (by or [])]), paths)


def compact(spark: SparkSession, path: str, merge: Merge, last: int, by: list[str] | None = None, fan: int = FAN) -> None:
    """Merge what is complete once batch ``last`` is stored. ``merge`` makes one part of the rows of several."""
    live = folders.newest(spark, path)
    counts, level = {}, 1
    while (last + 1) // fan**level > 0:
        counts[f"level={level}"] = (last + 1) // fan**level
        for number in range(_count(live, level), counts[f"level={level}"]):
            below = set(_there(spark, path, level - 1)) & set(range(number * fan, (number + 1) * fan))
            parts = [part_path(path, level - 1, n) for n in sorted(below)]
            write_part(merge(read_folders(spark, path, parts, by)), part_path(path, level, number), by)
        level += 1
    if all(live.numbers.get(k) == v for k, v in counts.items()):
        return
    for level in range(level - 1):  # what the manifest has passed over already
        for number in _there(spark, path, level):
            if 0 <= number < _count(live, level + 1) * fan:
                folders.delete(spark, part_path(path, level, number))
    folders.switch(spark, path, Live(live.version + 1, live.numbers | counts))
