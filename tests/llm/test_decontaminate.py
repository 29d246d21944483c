from mailgrain.llm import decontaminate
from tests.llm.helpers import docs, read, shingles, words

ITEMS = "item_id long, text string"


def found(spark, texts, items):
    rows = decontaminate.leaks(docs(spark, texts), docs(spark, items, ITEMS)).collect()
    return {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in rows}


def brute(texts, items):
    out = {}
    for i, t in texts:
        for k, x in items:
            own, w, v = shingles(x), words(x), words(t)
            if 0 < len(w) < 5:
                both = int(any(v[j : j + len(w)] == w for j in range(len(v))))
            else:
                both = len(own & shingles(t))
            if own and 100 * both >= 75 * len(own):
                out[(i, k)] = max(out.get((i, k), (0, 0)), (both, len(own)))
    return out


def test_smallest_tables_by_brute_force(spark):
    texts, items = read("documents", "doc_id, text"), read("benchmark", "item_id, text")
    want = brute(texts, items)
    assert want and found(spark, texts, items) == want


def test_scattered_partial_and_long(spark):
    item = [f"i{k}" for k in range(24)]  # 20 shingles, 15 needed
    filler = [f"f{k}" for k in range(30000)]
    texts = [
        (1, " ".join(filler[:15000] + item + filler[15000:])),
        (2, " ".join(filler[:9] + item[:19] + filler[9:20])),  # 15 of 20
        (3, " ".join(filler[:9] + item[:18] + filler[9:20])),  # 14 of 20
        (4, " ".join(item[:12] + filler[:5000] + item[8:] + filler[:7])),  # in two places
        (5, "\t".join(w.upper() for w in item)),
        (6, " ".join(filler)),
    ]
    items = [(1, " ".join(item)), (2, "two words"), (3, "f1 f2 f3 f4 f5"), (4, " ".join(filler[:40]))]
    got = found(spark, texts, items)
    assert got == brute(texts, items)
    assert {k for k in got if k[1] == 1} == {(1, 1), (2, 1), (4, 1), (5, 1)}


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta"
    texts = [(None, "x " + item, "q"), (1, None, "q"), (2, "", None), (3, item, "q"), (3, "nothing here", "q"), (3, item, "q"), (4, "two Words", "q")]
    items = [(None, item, 1), (7, item, 2), (7, item, 3), (8, None, 4), (9, "", 5), (10, "two words", 6)]
    frame = docs(spark, texts, "doc_id long, text string, item_id string")
    marks = docs(spark, items, "item_id long, text string, doc_id int")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame, marks).collect()), key=str)
    assert got == sorted([(None, None), (None, 7), (3, None), (3, 7), (4, 10)], key=str)
    none = docs(spark, [])
    assert decontaminate.leaks(none, marks).count() == 0
    assert decontaminate.leaks(frame, docs(spark, [], ITEMS)).count() == 0
    assert decontaminate.leaks(none, docs(spark, [], ITEMS)).count() == 0


def test_short_items_in_long_documents(spark):
    filler = [f"w{k}" for k in range(3000)]
    texts = [
        (1, " ".join(filler)),
        (2, "w10 w11 w12\tW13"),
        (3, "w10 w11 w12 w1 w13"),
        (4, "w13"),
        (5, " ".join(["x", "y"] * 2000)),  # a short item many times
        (6, "ax yb x"),  # parts of words are none
        (7, None),
        (8, "w2999"),
    ]
    items = [(1, "w10 w11 w12 w13"), (2, "w12 w13"), (3, "w2999"), (4, "x y"), (5, "W1 w2 w3"), (6, "w3 w1 w2"), (7, " ".join(filler[5:30])), (8, None), (9, "y x y x y")]
    got = found(spark, texts, items)
    assert got == brute(texts, items)
    assert {(1, 1), (2, 1), (1, 2), (2, 2), (1, 3), (8, 3), (5, 4), (1, 5), (1, 7), (5, 9)} == set(got)
    assert found(spark, texts, items[:6]) == brute(texts, items[:6])  # short items only
