"""Base spans, the field and its decoding against plain Python."""

import re

import numpy as np
import pytest

from mailgrain.llm import crf, pii, pii_rules
from tests.llm.helpers import docs, read

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]
ODD = [
    "", "a@b.c_d@e.f", "a@b.c@d.e x@y", "@a.b a@.b a@b. a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3.00000000255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "0" * 14, "0" * 20, "+1 (017) 555-7713, +123 +1-2", "+1+49 30 1234567()",
    "ü@mail.de ä.ö@x.y.z 日本 +49 30 123456789 日本", "a.b%c+d@x-y.z-w.", "1" * 5000 + ".2.3.4", "a@" * 2000 + "b.c",
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            good = (
                True,
                kind == 1 and all(len(p) < 100 and int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and total % 10 == 0,
                10 <= len(digits) <= 15,
            )
            if good[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return pii.trained(pii.labelled(spark))


def found(text, model):
    data = np.frombuffer(text.encode(), np.uint8)
    got = pii_rules.learned_spans(data, np.array([0, len(data)]), model)[1:]
    return [(text[a:b], pii_rules.LEARNED_KINDS[k]) for a, b, k in zip(*(x.tolist() for x in got), strict=True)]


def test_base_spans():
    for text in ODD + [t or "" for (t,) in read("documents", "text")]:
        assert pii_rules.base_spans(text) == brute(text), text[:80]


def test_spans_over_a_base_span_go():
    base, others = [(0, 0, 9), (2, 1, 3), (12, 0, 15)], [(4, 5, 6), (9, 5, 12), (14, 6, 20), (20, 5, 22)]
    assert pii_rules.outside(base, others) == [(9, 5, 12), (20, 5, 22)]
    assert pii_rules.outside([], others) == others


def test_the_field_learns_its_table_and_carries_over(model):
    for text, want in [
        ("reach me: (646) 555-0182 thanks", [("(646) 555-0182", "national_phone")]),
        ("Tel. 718-555-0147, or write", [("718-555-0147", "national_phone")]),
        ("geboren am 03.02.1966 in Bonn", [("03.02.1966", "birth_date")]),
        ("her SSN is 321-54-9876 now", [("321-54-9876", "identity")]),
        ("at 99 Hazel Street the", [("99 Hazel Street", "street")]),
        ("version 4.1, March 2011 of 300 pages, 12 or 13", []),
        ("no digits at all, Of Of The", []),
    ]:
        assert found(text, model) == want


def test_decoding_is_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    kinds, codes = 2, rng.integers(0, 2 * crf.SHAPES, (13, 2 * crf.SIDE + 1))
    move = rng.normal(0, 2, (5, 5)) + crf._allowed(5)
    model = crf.Model(rng.normal(0, 2, (2 * crf.SIDE + 1, 2 * crf.SHAPES, 1 + 2 * kinds)), move)
    offsets = np.array([0, 5, 6, 10, 13])
    place = np.arange(13)
    tags = crf.decode(crf.Stretches(place, place + 1, codes, offsets), model)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        emit = [sum(model.emit[o, codes[t, o]] for o in range(codes.shape[1])) for t in range(a, b)]
        best = max(
            np.ndindex(*[5] * (b - a)),
            key=lambda path: sum(e[y] for e, y in zip(emit, path, strict=True)) + sum(move[x, y] for x, y in zip((0, *path), (*path, 0), strict=True)),
        )
        assert tags[a:b].tolist() == list(best)


def test_training_raises_the_likelihood_by_its_gradient():
    """The sums forward and backward are right if the fitted field prefers the given tags."""
    text = "x 12 y 7 z 12 w 7 "
    data = np.frombuffer((text * 4).encode(), np.uint8)
    given = crf.stretches(data, np.array([0, len(data)]))
    tags = np.array([1 if data[a:b].tobytes() == b"12" else 0 for a, b in zip(given.start, given.end, strict=True)])
    assert (crf.decode(given, crf.fit(given, tags, 1)) == tags).all()


def test_stretches_do_not_cross_lines_texts_or_batches(model):
    texts = ["call (301) 555-0346 now\nborn", "03.04.1988 is a date", "tel", "(301) 555-0346"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    got = pii_rules.learned_spans(np.frombuffer(b"".join(raw), np.uint8), offsets, model)
    alone = []
    for i, r in enumerate(raw):
        own = pii_rules.learned_spans(np.frombuffer(r, np.uint8), np.array([0, len(r)]), model)
        alone += [(i, *x) for x in zip(*(x.tolist() for x in own[1:]), strict=True)]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == alone


def test_rows(spark, model, monkeypatch):
    line = "call (301) 555-0346 or Änn@x.de now\n"
    monkeypatch.setattr(pii, "SLICE_BYTES", 1000)
    rows = [(1, None), (2, ""), (None, line), (2, line), (3, line * 100), (4, line[:-1])]
    frame = docs(spark, rows).selectExpr("*", "9 AS spans", "text AS other")
    got = pii.scanned(frame, model, ["doc_id", "other", "spans"])
    assert got.columns == ["doc_id", "other", "spans"]
    spans = [[tuple(s) for s in r["spans"]] for r in got.collect()]
    one = [(5, 4, 19), (24, 0, 31)]
    assert spans[:4] == [[], [], one, one] and spans[5] == one
    assert spans[4] == [(36 * i + a, k, 36 * i + b) for i in range(100) for a, k, b in one]
    assert pii.scanned(docs(spark, []), model, ["doc_id"]).count() == 0


def test_no_labelled_rows(spark):
    for rows in ([], [(None, None), ("call 1", [(0, 3, "nothing")])]):
        model = pii.trained(spark.createDataFrame(rows, pii.LABELLED_SCHEMA))
        assert found("call (301) 555-0346", model) == []


def test_long_text_without_blanks(model):
    assert pii_rules.base_spans("7" * 300_000 + "a" * 300_000 + "@") == []
    assert found("7a" * 50_000, model) is not None
