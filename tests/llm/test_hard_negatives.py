"""Packed products and mined triples against plain Python."""

import math

import numpy as np
import pytest

from mailgrain.llm import hard_negatives, packed

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k_pos=5, k_neg=10):
    own = {}
    for i, vec, label in rows:
        if None in (i, vec, label) or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        value = (label, [math.floor(256 * float(np.float32(x))) for x in vec])
        own[i] = min(own.get(i, value), value)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in (i for i in own if i % every == 0):
        scored = sorted(((-dot(own[a][1], v), i, label) for i, (label, v) in own.items() if i != a))
        for p, i, _ in [x for x in scored if x[2] == own[a][0]][:k_pos]:
            hard = [x for x in scored if x[2] != own[a][0] and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j, _) in enumerate(hard[:k_neg], 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kind", "'x' AS score", "2 AS id")
    got = hard_negatives.mined(hard_negatives.usable(frame, 256, 7), **more)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("span", [1, 200, 5000, 10**6, 10**9, 10**15])
def test_products_are_exact(span):
    rng = np.random.default_rng(span % 97)
    a, r = rng.integers(-span, span + 1, (7, 9)), rng.integers(-span, span + 1, (23, 9))
    if span < 10**9:
        assert (packed.products(a, r) == a @ r.T).all()
    want = [[(sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) + 2**63) % 2**64 - 2**63 for q in r] for p in a]
    assert packed.products(a, r).tolist() == want


def test_products_of_nothing():
    assert packed.products(np.zeros((3, 0), np.int64), np.zeros((2, 0), np.int64)).tolist() == [[0, 0]] * 3


@pytest.mark.parametrize("block", [2, 16_384])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 8).round(1).tolist(), int(rng.integers(0, 3))) for i in range(0, 1200, 3)]
    assert mined(spark, rows, anchors_per_block=block) == brute(rows)


def test_odd_rows(spark):
    same = [0.5, 0.25, 0.0]
    rows = [(i, same, i % 2) for i in range(0, 300, 10)]  # ties everywhere
    rows += [(i, [0.25, 0.125], 5) for i in range(1, 30)]  # shorter vectors
    rows += [(None, same, 1), (401, None, 1), (402, same, None), (403, [0.1, None, 0.2], 1), (404, [float("nan")] * 3, 1)]
    rows += [(405, [float("inf"), 0.0, 0.0], 0), (100, [9.0, 9.0, 9.0], 9), (20, same, 0), (500, [], 0), (501, [3e38, 0.0, 0.0], 3)]
    assert mined(spark, [r for r in rows if r[0] != 501]) == brute([r for r in rows if r[0] != 501])
    assert mined(spark, rows)  # a component beyond 64 bits


def test_no_rows_and_no_partners(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 7), (100, [1.0], 2), (3, [0.5], 3)]) == []
