"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailgrain.operators import learn as L
from mailgrain.operators import store as T
from mailgrain.plans import catalog
from mailgrain.plans import views as V
from mailgrain.sources import exports as E
from mailgrain.sources import mailstore, tables

SF_DIR = "/root/testdata/sf0.001"
STREAMS = [n for n in catalog.QUERIES if n.startswith("stream_")]


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(STREAMS)))
def test_no_pairing_and_no_python(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF_DIR))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)


def test_counts_shuffle_once(spark):
    mail = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
        F.lit("m").alias("message_id"), F.col("source").alias("sender"), F.col("lang").alias("subject"),
        F.current_timestamp().alias("date_received"), F.col("text").alias("body_text"),
        F.create_map(F.lit("from"), F.col("source")).alias("headers"), F.lit(True).alias("has_attachment"),
    )
    plan = plan_of(L.pattern_counts(mail))
    assert len(re.findall(r"^\(\d+\) Exchange", plan, re.M)) == 1
    assert len(re.findall(r"^\(\d+\) HashAggregate", plan, re.M)) == 2


def test_only_needed_columns_are_read(spark):
    plan = plan_of(catalog.QUERIES["top_senders"](spark, SF_DIR))
    read = re.findall(r"ReadSchema: (\S+)", plan)
    assert read and all("text" not in r and "n_chars" not in r for r in read), read


def test_window_reads_only_its_folders(spark, tmp_path):
    mail = V.mail(spark, SF_DIR)
    mailstore.write_mail(mail, str(tmp_path / "m"), unit="month")
    stored = mailstore.read_mail(spark, str(tmp_path / "m"), StructType(list(mail.schema.fields)).add("received_on", "date"))
    as_of = F.lit("2025-06-30").cast("timestamp")
    some = E.window_scan(stored, as_of, 1)
    assert re.search(r"PartitionFilters: \[[^\]]*received_on", plan_of(some))
    want = E.window_scan(mail, as_of, 1).select("message_id")
    assert some.select("message_id").exceptAll(want).count() == 0 and some.count() == want.count() > 0


def test_retention_reads_only_its_folders(spark, tmp_path):
    mail = V.mail(spark, SF_DIR)
    mailstore.write_mail(mail, str(tmp_path / "m"))
    stored = mailstore.read_mail(spark, str(tmp_path / "m"), StructType(list(mail.schema.fields)).add("received_on", "date"))
    kept = T.retention(stored, F.lit("2025-06-30").cast("timestamp"))
    assert re.search(r"PartitionFilters: \[[^\]]*received_on", plan_of(kept))


def test_reading_shuffles_only_where_asked(spark):
    path = f"{SF_DIR}/documents.parquet"
    assert "Exchange" not in plan_of(tables.read_texts(spark, path, "doc_id"))
    spark.conf.set(tables.SPREAD, "4")
    try:
        assert "Exchange" in plan_of(tables.read_texts(spark, path, "doc_id"))
    finally:
        spark.conf.unset(tables.SPREAD)
