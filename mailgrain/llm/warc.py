"""WARC archives: writing pages as records, and a splittable reader.

A payload of at least ``LEAST_REVISIT`` bytes that several pages share is written once, by the page with the smallest id;
the others are revisit records that name that page. Each record is a gzip member of its own.

The reader cuts archives into byte ranges, one or more per task. A task looks for gzip magic in its range, tries
each candidate by decoding its record header, and owns the records that start in the range, to their ends. So large
archives are read in parallel without an index, and magic bytes within a record are told from a record's start.

Archives and their list lie in the shared folder; a list holds only files of finished tasks. Defined results: a
null html is an empty payload, a null url is left out; a page with a null id is a response; rows that share id and
payload are all what that id is; an empty table gives no archives; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailgrain.llm import warc_bytes
from mailgrain.llm.tables import stored
from mailgrain.session import shared_dir

LEAST_REVISIT = 100
RANGE_BYTES, MOST_TASKS = 16 << 20, 20_000


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the list of archives: ``path, bytes, records``."""
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest")
    )
    large = rows.filter(F.octet_length("html") >= LEAST_REVISIT).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = large.join(shared.drop("n"), "digest").filter("page_id != refers_to").distinct()
    records = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    records = records.sortWithinPartitions("page_id", "url", "html")
    written = records.mapInArrow(lambda it: warc_bytes.write(it, folder, date), "path string, bytes long, records long")
    return stored(written, "archives")


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the listed archives (path, bytes): ``path, offset, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest, intact, payload``."""
    step = F.lit(range_bytes).cast("long")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step)).alias("start")
    ranges = archives.filter("bytes > 0").select("path", begins, F.col("bytes").alias("size"))
    number = archives.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).head()[0] or 1
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, "size").alias("end"), "size")
    schema = (
        "path string, offset long, page_id long, url string, record_type string, refers_to long, "
        "payload_bytes long, payload_digest string, intact boolean, payload binary"
    )
    return ranges.repartition(int(min(number, MOST_TASKS))).mapInArrow(warc_bytes.read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh folder of the shared one and read the archives back."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession, "warc")))
