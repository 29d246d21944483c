"""Structured Streaming forms of the incremental writes.

Each stream runs over what is available and stops; with a trigger given it runs on, and the query is returned. Batches are
stored as mergeable parts in one folder per batch id: a retried batch replaces its own folder, so
retries and lost executors change nothing, and no batch rewrites what others stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mailgrain.functions.features import content_hash
from mailgrain.operators import actions as A
from mailgrain.operators import senders as S
from mailgrain.operators.joins import identity
from mailgrain.operators.store import hashed
from mailgrain.session import stored
from mailgrain.sources import folders
from mailgrain.streaming import parts as P


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _started(writer, trigger: dict | None) -> StreamingQuery:
    """Start a stream; without a trigger it runs over what is there, and this waits for its end."""
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None:
        query.awaitTermination()
    return query


def run_parts(
    stream: DataFrame, path: str, part: Callable[[DataFrame], DataFrame], trigger: dict | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None, fan: int = P.FAN,
) -> StreamingQuery:
    """Store ``part(batch)`` of every micro-batch under its batch id. A first, empty part gives the folder its schema. With
    ``merge``, which makes one part of several, the parts are merged in generations (see ``parts``)."""
    spark = stream.sparkSession
    empty = spark.createDataFrame([], stream.schema)
    P.write_part(part(empty), P.part_path(path, 0, -1))

    def store(batch: DataFrame, batch_id: int) -> None:
        P.write_part(part(batch), P.part_path(path, 0, batch_id))
        if merge:
            P.compact(spark, path, merge, batch_id, fan=fan)

    return _started(stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/progress"), trigger)


def read_parts(spark: SparkSession, path: str, fan: int = P.FAN, by: list[str] | None = None) -> DataFrame:
    return P.read_folders(spark, path, P.live_parts(spark, path, fan=fan), by)


def new_contents(spark: SparkSession, path: str, fan: int = P.FAN) -> DataFrame:
    """What ``run_new_contents`` has stored: content_hash and the place of the save that brought it."""
    return read_parts(spark, path, fan, ["prefix"])


def run_append(stream: DataFrame, path: str, trigger: dict | None = None) -> DataFrame:
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows")
    _started(writer.option("checkpointLocation", f"{path}/progress"), trigger)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def first_contents(mail: DataFrame, time: str, delay: str, salts: int = 32) -> DataFrame:
    """Each content hash once per watermark span, as long as repeats come within the delay.

    Repeats are dropped first per hash and salt, then per hash, so a text that makes up a third of
    a batch is spread over many tasks and reaches the last one as a few rows.
    """
    salt = F.pmod(F.xxhash64("message_id"), F.lit(salts))
    hashes = mail.select(time, content_hash(F.col("body_text")).alias("content_hash"), salt.alias("salt"))
    marked = hashes.withWatermark(time, delay)
    return (
        marked.dropDuplicatesWithinWatermark(["content_hash", "salt"])
        .dropDuplicatesWithinWatermark(["content_hash"])
        .select("content_hash")
    )


def run_new_contents(mail: DataFrame, path: str, trigger: dict | None = None, fan: int = P.FAN) -> StreamingQuery:
    """Store every content that no mail before it had, however long ago, with the message that brought it.

    Hashes lie in folders by their first two digits, and a micro-batch reads only the folders of its own hashes, of the
    batches before it. A content in a third of a batch is one row before the join. A batch that comes again is not
    compared with itself.
    ``mail``: its identity, ingest_seq, body_text.
    """
    spark = mail.sparkSession
    by, prefix = ["prefix"], F.substring("content_hash", 1, 2)

    def firsts(batch: DataFrame) -> DataFrame:
        rows = hashed(batch).filter("content_hash IS NOT NULL").withColumn("prefix", prefix)
        keys = identity(rows)
        first = rows.groupBy("content_hash", "prefix").agg(F.min(F.struct("ingest_seq", *keys)).alias("f"))
        return first.select("content_hash", "f.*", "prefix")

    def known(batch_id: int, asked: set[str]) -> DataFrame:
        live = P.live_parts(spark, path, batch_id, fan)
        there = [f"{p}/{name}" for p in live for name in sorted(asked & set(folders.names(spark, p)))]
        return folders.read(spark, StructType.fromDDL("content_hash string"), there)

    def store(batch: DataFrame, batch_id: int) -> None:
        found = stored(firsts(batch), "contents")
        asked = {f"prefix={r['prefix']}" for r in found.select("prefix").distinct().collect()}
        new = found.join(known(batch_id, asked), "content_hash", "left_anti")
        P.write_part(new.repartition("prefix"), P.part_path(path, 0, batch_id), by)
        P.compact(spark, path, lambda parts: parts.withColumn("prefix", prefix).repartition("prefix"), batch_id, by, fan)

    P.write_part(firsts(spark.createDataFrame([], mail.schema)), P.part_path(path, 0, -1))  # no rows, no inner folders
    return _started(mail.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/progress"), trigger)


def closed_hours(mail: DataFrame, time: str, delay: str) -> DataFrame:
    """Messages per hour of arrival, each hour once: when the watermark, ``delay`` behind the latest time seen, has passed its
    end. Mail that comes later than that is not counted. Only open hours are kept as state."""
    hours = mail.withWatermark(time, delay).groupBy(F.window(time, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.col("w.start").alias("hour_start"), "n")


def take_in(export: DataFrame, parse: Callable[[DataFrame], DataFrame], path: str, trigger: dict | None = None) -> DataFrame:
    """The mail of an export that grows by files. What was read is kept beside the mail, so that each run reads the
    new files only; a lost run goes on where it stopped. ``export`` is a stream of lines, ``parse`` makes mail of them."""
    return run_append(parse(export), path, trigger)


def hour_parts(mail: DataFrame, time: str) -> DataFrame:
    """Messages per hour of arrival of one batch."""
    return mail.groupBy(F.date_trunc("hour", time).alias("hour_start")).agg(F.count(F.lit(1)).alias("n"))


def merged_hours(parts: DataFrame) -> DataFrame:
    return parts.groupBy("hour_start").agg(F.sum("n").alias("n"))


def stream_hour_counts(mail: DataFrame, time: str, path: str) -> DataFrame:
    """Messages per hour of arrival. Every hour seen so far is there, the newest included, and late rows count."""
    run_parts(mail, path, lambda batch: hour_parts(batch, time), merge=merged_hours)
    return merged_hours(read_parts(mail.sparkSession, path))


def stream_sender_stats(saves: DataFrame, path: str) -> DataFrame:
    run_parts(saves, path, S.sender_parts, merge=S.merged_parts)
    return S.merge_sender_parts(read_parts(saves.sparkSession, path))


def stream_action_state(actions: DataFrame, mail: DataFrame, known_labels: DataFrame, path: str) -> DataFrame:
    run_parts(actions, path, lambda batch: A.last_ops(A.label_ops(batch, known_labels)), merge=A.last_ops)
    stored = read_parts(actions.sparkSession, path)
    return A.state_of(A.last_ops(A.initial_ops(mail, identity(actions)).unionByName(stored)))
