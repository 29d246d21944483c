"""Session settings the jobs rely on, and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every hour and date in the library is UTC unless a zone is passed.
    In imported JSON objects the last of a repeated key wins."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to a fresh folder of the shared one and read it back: lineage ends there."""
    path = shared_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A local master may go
    without; elsewhere a missing setting is an error, since a machine-local folder would be lost
    with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="mailgrain-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
