"""Every query of the package over the smallest tables, against its SQL where there is one; plans; the pipeline."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from mailgrain.llm.oracles import ORACLES
from mailgrain.llm.queries import QUERIES
from mailgrain.llm.tables import stored
from tests.compare import compare
from tests.llm.helpers import DOCS, SF_DIR, components, docs, read, shingles
from tests.llm.test_secret_scan import BASE

NATIVE = ("op1_", "op4_", "op5_", "op6_")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, SF_DIR, name)
    assert ok, note


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) < set(QUERIES) and {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith(NATIVE)))
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_no_task_of_the_last_stage_holds_two_python_workers(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(20)
    plan = corpus_pipeline.sentencepiece(spark, frame, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


def test_pipeline_by_brute_force(spark):
    """Each stage against plain Python on what the stage before kept; all decisions take effect."""
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, after = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = frame.collect()
        frame = stored(stage(spark, frame, SF_DIR), name)
        after[name] = frame.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frame.columns == corpus_pipeline.COLUMNS
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    quality = dict(read("labels", "doc_id, quality"))
    gone = set(ids(kept["quality_classifier"])) - set(ids(after["quality_classifier"]))
    judged = [i for i in gone if i in quality]
    assert gone and sum(quality[i] == 0 for i in judged) >= 0.8 * len(judged)
    rows = [(r["doc_id"], r["text"]) for r in kept["minhash_near_dedup"]]
    assert ids(after["minhash_near_dedup"]) == sorted(i for i, c in components(rows).items() if i == c)
    items = [shingles(t) for t in (t for _, t in read("benchmark", "item_id, text"))]
    leaks = lambda own: any(x and 100 * len(x & own) >= 75 * len(x) for x in items)
    clean = [r["doc_id"] for r in kept["benchmark_decontamination"] if not leaks(shingles(r["text"]))]
    assert ids(after["benchmark_decontamination"]) == sorted(clean)
    before = {r["doc_id"]: r for r in kept["secret_scans"]}
    for r in after["secret_scans"]:
        found = any(len(m.group(g)) >= n for _, p, g, n in BASE for m in p.finditer(before[r["doc_id"]]["text"]))
        assert (r["text"] != before[r["doc_id"]]["text"]) == found and r["n_chars"] == len(r["text"])
    assert ids(after["secret_scans"]) == ids(kept["secret_scans"])
    last = {r["doc_id"]: r for r in after["sentencepiece"]}
    assert all(last[r["doc_id"]]["text"] == r["text"] and last[r["doc_id"]]["n_pieces"] == len(last[r["doc_id"]]["pieces"]) for r in kept["sentencepiece"])
    assert sorted(last) == ids(kept["sentencepiece"])


def test_pipeline_on_odd_rows_and_an_empty_table(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", "en", None, 11), (2, "a b c d e f", "en", None, 11), (3, "token=abcdefgh12", None, "s", 16)]
    for given in (rows, []):
        frame = docs(spark, given, DOCS).withColumn("score", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES:
            frame = stored(stage(spark, frame, SF_DIR), name)
        assert set(corpus_pipeline.COLUMNS) <= set(frame.columns)
        if not given:
            assert frame.count() == 0
