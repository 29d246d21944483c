import random

from mailgrain.llm import graph, near_dedup
from tests.llm.helpers import components, docs, read, shingles


def groups(frame):
    return {r["doc_id"]: r for r in near_dedup.near_groups(frame).collect()}


def test_smallest_tables_by_brute_force(spark):
    rows = read("documents", "doc_id, text")
    want, got = components(rows), groups(docs(spark, rows))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingles(t)) for i, t in rows)


def test_star_with_unlike_arms_and_chains(spark):
    """Edited copies of one text are linked to it but not to each other; the text has the largest id."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(0, len(out), 6), n):
            out[at] = f"x{rng.random()}"
        return out

    rows = [(i, " ".join(edited(base, 3))) for i in range(40)] + [(500, " ".join(base))]
    link = base
    for i in range(100, 112):
        link = edited(link, 3)
        rows.append((i, " ".join(link)))
    rows += [(900 + i, " ".join(f"y{i}_{k}" for k in range(30))) for i in range(5)]
    got = groups(docs(spark, rows))
    assert {i: r["component_id"] for i, r in got.items()} == components(rows)
    assert got[500]["component_id"] == 0 and got[111]["component_id"] == 0


def families(rng, n, arms, size=60):
    """Texts of ``n`` families that share half of their words with all others, ``arms`` edited copies of each."""
    common = [f"c{i}" for i in range(size)]
    rows = []
    for f in range(n):
        base = common + [f"f{f}_{i}" for i in range(size // 2)]
        for _ in range(arms):
            out = list(base)
            for at in rng.sample(range(0, len(out), 6), 2):
                out[at] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(out)))
    return rows


def test_many_rounds_and_copies_by_brute_force(spark, monkeypatch):
    """One centre a bucket at first, twice as many in each next round, and every text and centre copied."""
    for name, value in (("FIRST_CENTRES", 1), ("MORE_CENTRES", 2), ("LOAD", 2), ("PAIRS", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = families(random.Random(6), 12, 6)
    assert {i: r["component_id"] for i, r in groups(docs(spark, rows)).items()} == components(rows)


def test_only_strays_go_on_in_a_bucket(spark):
    """A bucket of one component of 300 and two strays: later centres are the strays, and centres leave."""
    node = "band long, place int, node long, size long, shared long, pivot long, inside long, bands array<long>"
    rows = [(7, 0, i, 100, 100, i, 100, [7]) for i in range(302)]
    labels = docs(spark, [(i, 0 if i < 300 else i) for i in range(302)], "node long, root long")
    mixed = near_dedup.mixed_buckets(docs(spark, rows, node), labels)
    assert {(r["n"], r["top"]) for r in mixed.collect()} == {(302, 0)}
    centres = near_dedup.next_centres(mixed.filter("root != top"), 512)
    assert sorted(r["node"] for r in centres.collect()) == [300, 301]
    tried = docs(spark, [(0, 300)], "low long, high long")
    pairs = [(r["a"], r["b"]) for r in near_dedup.star_pairs(mixed, centres, tried, 512).collect()]
    assert len(pairs) == len(set(pairs)) == 2 * 300 - 1 + 1 and all(a >= 300 for a, _ in pairs)
    left = mixed.join(centres.select("band", "node"), ["band", "node"], "left_anti")
    assert near_dedup.mixed_buckets(left, labels).count() == 0


def test_threshold_is_met_exactly(spark):
    words = [f"w{i}" for i in range(11)]  # 7 shingles; six of them and two more make 6 / 8
    rows = [(1, " ".join(words)), (2, " ".join(words[:10] + ["other"])), (3, " ".join(["a", *words[1:10], "b"]))]
    got = groups(docs(spark, rows))
    assert 100 * 6 >= 75 * 8 and got[2]["component_id"] == 1 and got[3]["component_id"] == 3


def test_nulls_empty_texts_repeats_and_extra_columns(spark):
    long_text = " ".join(f"t{i % 977}" for i in range(60000))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (4, "Few Words", "d"), (5, "few  words", "e"), (6, "few words more", None),
        (7, "one two three four five", "f"), (7, "one two three four five", "f"), (None, "ONE two three four five", "g"),
        (None, "nobody else has these five words", "h"), (9, long_text, "i"), (10, long_text + " end", "j"),
    ]
    frame = docs(spark, rows, "doc_id long, text string, component_id string")
    out = near_dedup.near_groups(frame).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1] == got[1] and [got[i][0] for i in (1, 2, 3)] == [(0, 1, True), (0, 2, True), (0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] and got[6] == [(1, 6, True)]
    assert got[7] == [(1, 7, True)] * 2
    assert sorted(got[None], key=str) == sorted([(1, 7, False), (2, None, True)], key=str)
    assert got[10][0][1] == 9
    kept = near_dedup.one_of_each(frame.select("doc_id", "text")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [
        (False, 1), (False, 2), (False, 3), (False, 4), (False, 6), (False, 7), (False, 9), (True, 0)
    ]


def test_empty_table(spark):
    frame = docs(spark, [])
    assert near_dedup.near_groups(frame).count() == 0 and near_dedup.one_of_each(frame).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["root"] for r in graph.components(docs(spark, edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[100 + i] == 100 for i in range(30)) and got[300] == 299
