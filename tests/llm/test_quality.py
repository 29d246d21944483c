from zlib import crc32

import duckdb
import numpy as np

from mailgrain.llm import quality, quality_net
from mailgrain.llm.queries import QUERIES
from tests.llm.helpers import docs


def test_held_out_accuracy(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    QUERIES["op2_quality_classifier"](spark, sf_dir).write.parquet(str(tmp_path / "o"))
    right, n, low, high = duckdb.sql(f"""
        SELECT avg(CAST(predicted = quality AS INT)), count(*), min(score), max(score)
        FROM '{tmp_path}/o/*.parquet' JOIN '{sf_dir}/labels.parquet' USING (doc_id) WHERE held_out""").fetchall()[0]
    assert n > 50 and right >= 0.95 and 0 <= low <= high <= 1


def test_labels_kept_out_do_not_matter(spark):
    texts = docs(spark, [(i, "good plain words " * 3 + str(i) if i % 2 else f"bad!! {i}!! ??" * 3) for i in range(60)])
    out = texts.select("doc_id", quality.held_out(texts["doc_id"]).alias("h")).collect()
    held = {r["doc_id"] for r in out if r["h"]}
    assert 0 < len(held) < 60
    one = docs(spark, [(i, i % 2) for i in range(60)], "doc_id long, quality int")
    two = docs(spark, [(i, 1 - i % 2 if i in held else i % 2) for i in range(60)], "doc_id long, quality int")
    first, second = (
        {r["doc_id"]: r["score"] for r in quality.with_scores(texts, labels, ["doc_id"]).collect()} for labels in (one, two)
    )
    assert first == second and all((first[i] >= 0.5) == bool(i % 2) for i in range(60))


def test_an_id_with_most_rows_is_learned_from_once(spark):
    once = [(i, f"good plain words {i}" if i % 2 else f"bad!! {i}!! ??") for i in range(60)]
    hot = next(i for i, _ in once if crc32(str(i).encode()) % 3 != 1)
    labels = docs(spark, [(i, i % 2) for i in range(60)], "doc_id long, quality int")
    table = quality.word_vectors(docs(spark, once))
    want = quality.learned(docs(spark, once), labels, table, 60)
    for rows in ([once[hot]] * 400 + once, once + [once[hot]] * 400):
        got = quality.learned(docs(spark, rows), labels, table, 60)
        assert all(np.array_equal(vars(got)[k], v) for k, v in vars(want).items())
    other = [(hot, f"another text {i}") for i in range(200)] + once
    one, two = (quality.learned(docs(spark, rows), labels, table, 60) for rows in (other, other[::-1]))
    assert all(np.array_equal(vars(two)[k], v) for k, v in vars(one).items())


def test_nulls_and_empty_tables(spark):
    rows = [(1, None, 9), (2, "", 9), (None, "some text", None), (3, "a " * 50000, 9), (3, "a b", 9), (3, "a b", 9)]
    frame = docs(spark, rows, "doc_id long, text string, score int")
    labels = docs(spark, [(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    out = quality.with_scores(frame, labels, ["doc_id", "text"]).collect()
    assert len(out) == 6 and {r["score"] for r in out} == {0.5}
    assert quality.with_scores(docs(spark, []), labels, ["doc_id"]).count() == 0
    assert quality.with_scores(frame, docs(spark, [], "doc_id long, quality int"), ["doc_id"]).count() == 6


def test_vectors_are_sums_of_neighbours():
    data = np.frombuffer("ab cd ab!".encode() + "ef".encode(), np.uint8)
    places, signs = quality_net.spikes()
    offsets = np.array([0, 9, 11])
    bucket, starts = quality_net.tokens(data, offsets)
    assert starts.tolist() == [0, 4, 5] and bucket[0] == bucket[2]
    want = np.zeros((quality_net.BUCKETS, quality_net.WIDTH))
    for i in range(4):
        for j in (i - 1, i + 1):
            if 0 <= j < 4:
                want[bucket[i], places[bucket[j]]] += signs[bucket[j]]
    assert (quality_net.contexts(data, offsets, places, signs).reshape(want.shape) == want).all()


def test_temperature_is_chosen_on_rows_kept_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < quality_net.sigmoid(2 * x[:, 0])).astype(float)
    net = quality_net.fit(x, y)
    p = net.score(x)
    assert abs(p[p > 0.8].mean() - y[p > 0.8].mean()) < 0.05 and 0.25 <= net.temperature <= 8
