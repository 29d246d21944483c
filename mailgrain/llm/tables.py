"""Tables in the cluster's shared folder: lineage ends there, so a lost executor costs one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailgrain.session import shared_dir


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to a fresh folder below ``spark.checkpoint.dir`` and read it back."""
    spark = frame.sparkSession
    path = shared_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    """Where an installed public vocabulary lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
