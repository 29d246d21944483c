"""CRCs of stretches, runs of words and ranks against plain Python."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from mailgrain.llm import resample, word_runs
from mailgrain.llm.prefix_crc import Running, stretch_crc
from tests.llm.helpers import docs

ODD = [None, "", " .,-", "Ünïcode ÄÖ a1b2 日本語", "The the THE", "x" * 700, "a\x00b\x7fc\x80d", "one two three " * 300]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest=1, least=20, percent=10, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in side for f in features(x, longest)) for side in ([x for _, x in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        own = features(x, longest)
        weight = sum(math.floor(1000 * math.log((t[of(f)] + 1) * (big_s + buckets) / ((s[of(f)] + 1) * (big_t + buckets)))) for f in own)
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, None, len(words(x)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def test_crc_of_any_stretch():
    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    start = np.array([0, 0, 1, 255, 256, 257, 4999, 5000, 17])
    end = np.array([0, 5000, 1, 256, 600, 257, 5000, 5000, 4000])
    got = stretch_crc(Running(data), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert stretch_crc(Running(data[:0]), np.array([0]), np.array([0])).tolist() == [0]


@pytest.mark.parametrize("limit", [64, 1 << 20])
@pytest.mark.parametrize("longest", [1, 3])
def test_buckets_of_runs_whole_or_in_parts(longest, limit):
    found = [[] for _ in ODD]
    for first, _, bucket, row, _ in word_runs.measured(pa.array(ODD), longest, 997, limit):
        for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
            found[first + r].append(b)
    want = [sorted(zlib.crc32(f.encode()) % 997 for f in features(x, longest)) for x in ODD]
    assert [sorted(x) for x in found] == want


@pytest.mark.parametrize("longest", [1, 2])
def test_against_brute_force(spark, longest):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 60)))) for i in range(80)]
    rows += [(1000 + i, x) for i, x in enumerate(ODD)] + [(None, rows[0][1])]
    target = [" ".join(rng.choice(vocabulary[:10], 30)) for _ in range(5)] + [None]
    frame = docs(spark, rows).selectExpr("*", "1 AS rank", "2 AS bucket", "'x' AS score")
    got = resample.resampled(frame, docs(spark, [(None, t) for t in target]), longest=longest)
    got = got.select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, target, longest), key=key)


def test_equal_rows_get_ranks_without_gaps(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u"
    got = resample.resampled(docs(spark, [(5, text)] * 40 + [(6, "a b")]), docs(spark, [(1, "a b c")]), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert [r["rank"] for r in got if r["doc_id"] == 6] == [None]


def test_empty_tables(spark):
    none, some = docs(spark, []), docs(spark, [(1, "a " * 30), (2, "b " * 30)])
    assert resample.resampled(none, some).count() == 0
    got = resample.resampled(some, none, percent=50).collect()
    assert sorted(r["n_features"] for r in got) == [30, 30] and sorted(str(r["rank"]) for r in got) == ["1", "None"]
