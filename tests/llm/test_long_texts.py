"""Long texts: words that sums alone do not tell apart, unbroken stretches, bounded memory."""

import base64
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from mailgrain.llm import arrays, minhash, near_dedup, pieces, quality_net, word_runs
from mailgrain.llm.tables import vocabulary
from tests.llm.helpers import docs

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def balanced(n, first="ab"):
    """a, b, b, a, b, a, a, b, ...: each half is the complement of the other."""
    return "".join(first[bin(i).count("1") % 2] for i in range(n))


TWINS = [(balanced(n), balanced(n, "ba")) for n in (16, 64, 1024, 4096)]


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(vocabulary())


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_regular_words_differ_from_their_complements(spark, vocab):
    texts = [t for pair in TWINS for t in pair]
    hashes, _ = arrays.words(*flat([f"{t} " for t in texts]), lower=True)
    assert len(set(hashes.tolist())) == len(texts)
    rows = list(enumerate(texts))
    groups = near_dedup.near_groups(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in groups} == {i: i for i, _ in rows}
    ids, starts = pieces.sample(texts, np.arange(len(texts)).astype(np.uint64), vocab, 1.0)
    data, ends = pieces.decode(ids, starts, vocab)
    assert [data.tobytes()[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    assert pieces.count_tokens(texts, vocab, pieces.Known(1 << 10)).tolist() == [len(library.encode(t)) for t in texts]


def test_unbroken_texts_count_like_the_library(vocab):
    rng = random.Random(5)
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary())
    texts = [
        "".join(rng.choices(LETTERS, k=100_000)), base64.b64encode(rng.randbytes(75_000)).decode(), "=" * 100_001, "a" * 99_999,
        "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(100_000)), "".join(rng.choices(["the", "ing", "é", "▁", "日本"], k=30_000)),
    ]
    start = time.monotonic()
    got = pieces.count_tokens(texts, vocab, pieces.Known(1 << 10)).tolist()
    assert time.monotonic() - start < 30
    assert got == [len(library.encode(t)) for t in texts]


def test_merging_place_by_place_equals_merging_in_step(vocab):
    rng = random.Random(6)
    for _ in range(200):
        text = "▁" + "".join(rng.choices(["a", "b", "th", "e", "ing", "==", "1", "!"], k=rng.randrange(1, 60)))
        ids = vocab.char_id[[ord(c) for c in text]]
        left, alone = pieces.merge_in_step(ids.copy(), np.array([0, len(ids)]), vocab)
        assert (left[0], alone[0]) == pieces.merge_long(ids, vocab)


def test_pools_by_a_plain_version():
    table = np.random.default_rng(0).normal(0, 1, (quality_net.BUCKETS, quality_net.WIDTH)).astype(np.float32)
    texts = ["", "one two  Three", "x", "a1 b2-c3\n!!", "é ü"]
    data, offsets = flat(texts)
    bucket, starts = quality_net.tokens(data, offsets)
    got = quality_net.pooled(data, offsets, table)
    for i in range(len(texts)):
        own = table[bucket[starts[i] : starts[i + 1]]].astype(np.float64)
        if not len(own):
            assert not got[i].any()
            continue
        near = (own[:-1] * own[1:]).sum(axis=0) / max(1, len(own) - 1)
        assert np.allclose(got[i], np.concatenate((own.mean(axis=0), own.std(axis=0), near)), atol=2e-3)


def test_a_long_text_is_pooled_in_parts_of_bounded_memory():
    table = np.random.default_rng(0).normal(0, 1, (quality_net.BUCKETS, quality_net.WIDTH)).astype(np.float32)
    words = np.random.default_rng(1).choice(["the", "Thing", "12", "of,", "ß."], 4_000_000)
    data, offsets = flat([" ".join(words.tolist())])
    assert len(data) > 14 << 20
    tracemalloc.start()
    got = quality_net.pooled(data, offsets, table, 256 << 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    short = data[: 1 << 20]
    bounds = np.array([0, len(short)])
    whole, parts = quality_net.pooled(short, bounds, table), quality_net.pooled(short, bounds, table, 64 << 10)
    assert np.allclose(whole, parts, atol=1e-3) and np.isfinite(got).all()


def test_parts_are_the_text():
    for text in (b"", b"abc", b"ab cd ef gh", b"x" * 50, b" " * 50, b"ab " * 40 + b"y" * 60 + b" z"):
        data = np.frombuffer(text, np.uint8)
        cut = list(arrays.parts(data, 8))
        assert b"".join(p.tobytes() for p in cut) == text
        assert all(p.tobytes()[-1:] == b" " for p in cut[:-1])
    assert word_runs.normalised(data[:0], np.array([0, 0]))[0].size == 0


def first_peak(make):
    """Most MB that are held until the first batch comes."""
    tracemalloc.start()
    next(make())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / (1 << 20)


def test_a_batch_of_many_texts_is_worked_on_in_slices_of_bounded_memory():
    held = type("Held", (), {"value": vars(pieces.load(vocabulary()))})
    ids, texts = pa.array(range(4000)), pa.array(["ab cd " * 2000] * 4000)
    batch = pa.RecordBatch.from_arrays([ids, texts], ["_seed", "_text"])
    assert first_peak(lambda: pieces.encoded([batch], held, 1.0, 16 << 10)) < 10
    rng = random.Random(1)
    ids, texts = pa.array(range(1000)), pa.array([" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(1000)])
    arrays.powers(1 << 20)
    batch = pa.RecordBatch.from_arrays([ids, ids, texts], ["doc_id", "text_key", "text"])
    assert first_peak(lambda: minhash.describe([batch], near_dedup.WIDTH, 160, 4, near_dedup.SLICE_BYTES)) < 8
