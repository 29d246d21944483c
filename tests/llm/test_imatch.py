import hashlib

import pytest
from pyspark.sql import functions as F

from mailgrain.llm import imatch
from tests.llm.helpers import docs, read


def run(frame):
    return imatch.fingerprints(frame).collect()


@pytest.fixture(scope="module")
def small(spark):
    return read("documents", "doc_id, text"), run(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_edited_texts_by_brute_force(small):
    rows, got = small
    got, rows = {r["doc_id"]: r for r in got}, sorted(rows, reverse=True)
    for i, (doc_id, text) in enumerate(rows):
        following, cut = rows[(i + 1) % len(rows)][1] or "", len(text or "") // 3
        edited = (text or "")[: len(text or "") - cut] + following[:cut]
        assert got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[doc_id]["n_chars"] == len(text or "")


def test_likeness_tells_edited_from_other_texts(small):
    rows, got = small
    text = dict(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(text[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    near, other = sorted(r["near_edited"] for r in got), sorted(r["near_next"] for r in got)
    assert 0 <= min(near + other) and max(near + other) <= 1
    assert near[len(near) // 2] >= 0.2 and sum(other) / len(other) < 0.05


def test_parts_by_brute_force(spark):
    """A part is empty or not by which terms of the lexicon fall into its subset; equal sets give equal parts."""
    rows = [(i, " ".join(f"t{(i * 7 + k) % 40}" for k in range(i % 9 + 3)) + f" own{i}") for i in range(60)]
    frame = docs(spark, [*rows, (100, rows[5][1].upper() + " " + rows[5][1])])
    got = {r["doc_id"]: r for r in run(frame)}
    assert got[100]["fingerprint"] == got[5]["fingerprint"]
    length = len(imatch.RATES) * imatch.SUBSETS
    for r in got.values():
        digits = r["fingerprint"].replace("-", "")
        assert r["fingerprint"].count("-") + len(digits) // (imatch.BITS // 4) == length


def test_texts_with_one_kept_term_have_prints_of_their_own(spark):
    """Where few subsets hold the one term, only the width of a part tells two texts from each other."""
    words = docs(spark, [(i, f"w{i}") for i in range(5000)])
    parts = imatch.parts(F.col("text"), F.from_json(F.lit(str([[]] * imatch.SLOTS)), "array<array<bigint>>"))
    filled = words.select(F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("part"), "text").distinct()
    total, different = filled.select("text").distinct().count(), filled.select("part").distinct().count()
    assert different > 0.99 * total and total == 5000


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(3, None, 1), (2, "", 1), (2, "two two", 1), (1, "aa bb cc", 2), (1, "aa bb cc", 2), (None, "zz yy xx ww", 3)]
    out = run(docs(spark, rows, "doc_id long, text string, fingerprint int"))
    assert len(out) == 6 and sorted(r["n_chars"] for r in out) == [0, 0, 7, 8, 8, 11]
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0] == by_id[1][1]
    assert by_id[1][0]["edited_sha256"] == hashlib.sha256(b"aa bb zz").hexdigest()
    assert by_id[3][0]["near_edited"] == 1.0
    alone = run(docs(spark, [(5, "just one text of six words")]))
    assert alone[0]["near_next"] == 1.0 and run(docs(spark, [])) == []


def test_order_of_many_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("doc_id"), F.xxhash64("id").alias("key"), F.lit(30).alias("n_chars"))
    links = {r["of_id"]: r["doc_id"] for r in imatch.followers(rows).collect()}
    ids = sorted((i * 37 % 1009 for i in range(1000)), reverse=True)
    assert links == {a: b for a, b in zip(ids, ids[1:] + ids[:1])}
