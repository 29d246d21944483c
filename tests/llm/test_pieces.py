import itertools
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from mailgrain.llm import arrays, piece_sampling, pieces, token_counts
from mailgrain.llm.tables import vocabulary
from tests.llm.helpers import docs, read

BITS = ["a", "b", "the", " ", "  ", " " * 15, " " * 33, "\n", "▁", "é", "😀", "<s>", "</s>", "<0x0A>", "ing", "!!", "　", "\t", "ion", "aa", "==", "中", "\x00", "ﬁ"]


def texts(n=3000, seed=3):
    rng = random.Random(seed)
    out = ["".join(rng.choices(BITS, k=rng.randrange(50))) for _ in range(n)]
    return [*out, "", " ", "a" * 5000, " " * 3333, "=" * 4000, "ab" * 3000, "a b" * 100, "-" * 777 + " " * 35 + "x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary())


@pytest.fixture(scope="module")
def vocab():
    return pieces.load(vocabulary())


def test_counts_equal_the_library(spark, library):
    rows = list(enumerate(texts())) + [(10_000 + i, t) for i, t in read("documents", "doc_id, text")]
    frame = docs(spark, [*rows, (None, None), (1, "again")], "doc_id long, text string")
    out = token_counts.token_counts(frame, vocabulary()).collect()
    assert len(out) == len(rows) + 2
    want = Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in [*rows, (None, None), (1, "again")])
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in out)
    assert token_counts.token_counts(docs(spark, []), vocabulary()).count() == 0


def test_forgetting_changes_nothing(vocab):
    some = texts(500)
    full, small = pieces.Known(1 << 20), pieces.Known(3)
    assert (pieces.count_tokens(some, vocab, full) == pieces.count_tokens(some, vocab, small)).all()


def test_decoding_is_lossless_and_rows_are_independent(vocab, library):
    some = [*texts(), None]
    seeds = np.arange(len(some)).astype(np.uint64)
    ids, starts = pieces.sample(some, seeds, vocab, 0.7)
    data, ends = pieces.decode(ids, starts, vocab)
    assert [data.tobytes()[a:b].decode() for a, b in zip(ends[:-1], ends[1:])] == [t or "" for t in some]
    part, part_starts = pieces.sample(some[70:90], seeds[70:90], vocab, 0.7)
    assert (part == ids[starts[70] : starts[90]]).all() and (part_starts == starts[70:91] - starts[70]).all()
    for k in range(0, 200):
        if "▁" not in some[k]:
            assert library.decode([int(i) for i in ids[starts[k] : starts[k + 1]]]) == some[k]


def test_chances_equal_the_products_of_weights(vocab, library):
    word, n = "▁theing", 40_000
    ids = {library.id_to_piece(i): i for i in range(259, library.vocab_size())}
    chance = {}
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in ids for p in parts):
            own = tuple(ids[p] for p in parts)
            chance[own] = float(np.exp(2 * sum(vocab.log_weight[i] for i in own)))
    got, starts = pieces.sample([word[1:]] * n, np.arange(n).astype(np.uint64), vocab, 2.0)
    seen = Counter(tuple(got[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:]))
    total = sum(chance.values())
    assert set(seen) <= set(chance)
    assert all(abs(seen[k] / n - p / total) < 5 * np.sqrt(p / total / n) + 1e-4 for k, p in chance.items())


def test_encode_and_decode_tables(spark):
    rows = [(1, "some text", 7, "x"), (1, "some text", 7, "x"), (None, None, 7, None), (2, "", 8, "y"), (3, "words " * 40000, 9, "z")]
    frame = docs(spark, rows, "doc_id long, text string, pieces int, other string")
    coded = piece_sampling.encode(frame, vocabulary(), F.col("doc_id"), F.col("text"))
    assert coded.columns == ["doc_id", "other", "pieces"]
    same = coded.filter("doc_id = 1").collect()
    assert same[0]["pieces"] == same[1]["pieces"]
    back = sorted(((r["doc_id"], r["text"], r["other"]) for r in piece_sampling.decode(coded, vocabulary()).collect()), key=str)
    assert back == sorted(((i, t or "", o) for i, t, _, o in rows), key=str)
    other = piece_sampling.encode(frame, vocabulary(), F.col("doc_id"), F.col("text"), seed=1).filter("doc_id = 3").head()
    assert other["pieces"] != coded.filter("doc_id = 3").head()["pieces"]
    null = coded.select("doc_id", F.lit(None).cast("array<int>").alias("pieces"))
    assert {r["text"] for r in piece_sampling.decode(null, vocabulary()).collect()} == {None}
    empty = piece_sampling.encode(docs(spark, []), vocabulary(), F.col("doc_id"), F.col("text"))
    assert piece_sampling.decode(empty, vocabulary()).count() == 0


def test_words_and_shingles_by_brute_force():
    from tests.llm.helpers import words

    some = ["", "One  two\tthree\nfour five six", " x ", "a", "É é Ab", "\v\f"]
    raw = [t.encode() for t in some]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, starts = arrays.words(data, offsets, lower=True)
    assert np.diff(starts).tolist() == [len(words(t)) for t in some]
    _, per = arrays.shingles(hashes, starts, 5)
    assert np.diff(per).tolist() == [0, 2, 1, 1, 1, 0]
