"""Batches of saves merged into stored mail: only the dated folders that a batch touches are read and written.

A store holds ``rows/gen=g/received_on=d``, the mail, and ``places/gen=g/prefix=p``, the folder and age of each message by the
first digits of its key. A manifest names the generation that holds each date and each prefix. A batch

1. looks its messages up in the places of its prefixes, where their dates and the numbers of their last saves stand,
2. keeps those of its saves that are newer, and takes the rows of the dates that these leave and come to,
3. writes those dates and the winners' prefixes as a new generation, and switches the manifest.

All else stays as it is. A batch that comes again has nothing newer and touches nothing; one that was lost on its way
changes nothing either, for before the switch nobody reads what it wrote. The driver holds the names of folders only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from mailgrain.operators.joins import identity, pick_per_key
from mailgrain.session import stored
from mailgrain.sources import folders, mailstore
from mailgrain.sources.folders import Live

_PLACE = "mail_key string, received_on string, ingest_seq long, date_received timestamp"
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def mail_key(rows: DataFrame) -> Column:
    """A digest of what tells a message apart; absent parts count, too."""
    return F.md5(F.to_json(F.struct(*identity(rows))))


def _folder(unit: str) -> Column:
    return F.coalesce(F.to_date(F.date_trunc(unit, "date_received")).cast("string"), F.lit(_NO_DATE))


def _paths(path: str, live: Live, part: str, wanted: list[str]) -> list[str]:
    return [f"{path}/{part}/gen={live.numbers[name]}/{name}" for name in wanted if name in live.numbers]


def _folders_of(rows: DataFrame, name: str, value: Column) -> list[str]:
    """The folders in which some rows lie; there are no more than the store has, or the rows bring."""
    return sorted(f"{name}={r[0]}" for r in rows.select(value).distinct().collect())


def _last(batch: DataFrame) -> DataFrame:
    """The last save of each message, one row for each key; of saves that are alike in number and date, one in a fixed order."""
    plain = [f.name for f in batch.schema.fields if f.dataType.typeName() != "map"]
    rows = stored(batch.withColumns({"_key": mail_key(batch), "_tie": F.xxhash64(*plain)}), "saves")
    return pick_per_key(rows, ["_key"], ["ingest_seq", "date_received", "_tie"], latest=True).dropDuplicates(["_key"]).drop("_tie")


def merge_mail(batch: DataFrame, path: str, unit: str = "day", prefix_digits: int = 2) -> list[str]:
    """Merge a batch of saves (identity, date_received, ingest_seq and any others) into the store at ``path``; the names of the dated
    folders that were touched. All batches of a store have the same columns, unit and number of digits.

    Which saves win is settled on keys and ages alone. The rows of the folders found are read once, and but for the
    final write no body is shuffled while the batch's keys fit Spark's broadcast threshold."""
    spark, live = batch.sparkSession, folders.newest(batch.sparkSession, path)
    now, columns, prefix = live.version + 1, batch.columns, F.substring("mail_key", 1, prefix_digits)
    last = stored(_last(batch).withColumn("_folder", _folder(unit)), "batch")
    keys = last.select(F.col("_key").alias("mail_key"), F.col("_folder").alias("received_on"), "ingest_seq", "date_received")
    asked = _folders_of(keys, "prefix", prefix)
    places = folders.read(spark, StructType.fromDDL(_PLACE), _paths(path, live, "places", asked))
    known = places.select("mail_key", F.col("received_on").alias("old"), F.struct("ingest_seq", "date_received").alias("age"))
    newer = F.col("age").isNull() | (F.struct("ingest_seq", "date_received") > F.col("age"))
    won = stored(keys.join(known, "mail_key", "left").filter(newer).drop("age"), "won")
    prefixes, new = _folders_of(won, "prefix", prefix), _folders_of(won, "received_on", F.col("received_on"))
    if not new:
        return []
    dates = sorted({*new, *_folders_of(won.filter("old IS NOT NULL"), "received_on", F.col("old"))})
    old = folders.read(spark, batch.schema, _paths(path, live, "rows", dates))
    winners = won.select(F.col("mail_key").alias("_key"))
    kept = old.withColumn("_key", mail_key(old)).join(winners, "_key", "left_anti")
    rows = kept.select(columns).unionByName(last.join(winners, "_key", "left_semi").select(columns))
    mailstore.write_mail(rows, f"{path}/rows/gen={now}", "overwrite", unit)
    written = [n for n in folders.names(spark, f"{path}/rows/gen={now}") if n.startswith("received_on=")]
    others = folders.read(spark, StructType.fromDDL(_PLACE), _paths(path, live, "places", prefixes))
    every = others.join(won.select("mail_key"), "mail_key", "left_anti").unionByName(won.drop("old")).withColumn("prefix", prefix)
    every.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/places/gen={now}")
    numbers = {k: v for k, v in live.numbers.items() if k not in {*dates, *prefixes}}
    folders.switch(spark, path, Live(now, numbers | dict.fromkeys([*written, *prefixes], now)))
    return dates


def read_merged(spark: SparkSession, path: str, schema: StructType, since: str = "", until: str = "9") -> DataFrame:
    """The stored mail, of folders from ``since`` to ``until`` (ISO dates) only if these are given. Mail without a date lies in a folder
    behind all dates."""
    live = folders.newest(spark, path)
    dated = sorted(n for n in live.numbers if n.startswith("received_on="))
    asked = [n for n in dated if since <= n.removeprefix("received_on=") and (until == "9" or n.removeprefix("received_on=") <= until)]
    return folders.read(spark, schema, _paths(path, live, "rows", asked))


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the folders that the manifest does not name; how many there were. For times when nobody reads an older state."""
    live, gone = folders.newest(spark, path), 0
    for part in ("rows", "places"):
        for gen in folders.names(spark, f"{path}/{part}"):
            number = int(gen.removeprefix("gen="))
            inner = [n for n in folders.names(spark, f"{path}/{part}/{gen}") if "=" in n]
            dead = [n for n in inner if live.numbers.get(n) != number]
            for name in dead if len(dead) < len(inner) else []:
                folders.delete(spark, f"{path}/{part}/{gen}/{name}")
            if len(dead) == len(inner):
                folders.delete(spark, f"{path}/{part}/{gen}")
            gone += len(dead)
    return gone
