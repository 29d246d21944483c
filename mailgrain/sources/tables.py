"""Reading Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: over how many partitions a caller wants rows of long texts dealt on reading. Unset, nothing
#: is shuffled, whatever the size; it is for inputs that lie in one row group, which one task would read alone.
SPREAD = "mailgrain.read.spread"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows, spread = read(spark, path), spark.conf.get(SPREAD, None)
    return rows.repartition(int(spread), key) if spread else rows
