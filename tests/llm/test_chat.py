import random

from pyspark.sql import functions as F

from mailgrain.llm import chat
from tests.llm.helpers import docs

TREE = "conv_id long, node long, parent long, role string, text string, score double"
TURNS = "conv_id long, turn long, role string, text string"


def paths(spark, rows, branches):
    out = {}
    for r in chat.chosen_paths(docs(spark, rows, TREE), branches).collect():
        out.setdefault((r["conv_id"], r["branch"]), []).append((r["depth"], r["text"]))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def brute(rows, branches):
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        inner = {r[2] for r in own.values() if r[2] in own}
        ranked = []
        for leaf in own.keys() - inner:
            path, at = [], leaf
            while at in own:
                path.append(own[at])
                at = own[at][2]
            ranked.append((-sum(r[5] for r in path) / len(path), leaf, [r[4] for r in reversed(path)]))
        for k, (_, _, texts) in enumerate(sorted(ranked)[:branches]):
            out[(conv, k + 1)] = texts
    return out


def test_trees_by_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        for node in range(rng.randint(1, 40)):
            parent = rng.randrange(node) if node and rng.random() > 0.05 else None
            rows.append((conv, node, parent, "user", f"{conv}:{node}", float(rng.randrange(5))))
    rows += [(99, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(130)]
    assert paths(spark, rows, 1) == brute(rows, 1)
    assert paths(spark, rows, 3) == brute(rows, 3)


def test_missing_parents_and_cycles(spark):
    rows = [(1, 1, 77, "user", "root", 0.0), (1, 2, 1, "user", "leaf", 0.0), (2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0)]
    assert paths(spark, rows, 2) == {(1, 1): ["root", "leaf"]}


def test_escapes_are_undone(spark):
    rng = random.Random(2)
    bits = ["[INST]", "[/INST]", "</s>", "<", "[", "]", "\\", "\\l", "\\e", "\\\\e", "text", "\n", "é😀", "[ROLE:x]", "$1", " "]
    rows = [(i, k, rng.choice(["user", "assistant", "system", "tool]x", "[a\\l"]), "".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(60) for k in range(4)]
    done = chat.formatted(chat.chosen_paths(chat.linear(docs(spark, rows, TURNS))))
    out = done.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    for r in out:
        own = [(role, text) for i, _, role, text in rows if i == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == own
        assert r["l"] == "".join(text for role, text in own if role == "assistant")


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(1, 0, None, None, 5), (1, 1, "user", "b", 5), (1, 1, "user", "a", 5), (1, 1, "user", "a", 5), (None, 3, "assistant", "x", 5), (None, 1, "user", "", 5)]
    done = chat.formatted(chat.chosen_paths(chat.linear(docs(spark, rows, TURNS + ", branch int"))))
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert out == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", ""), ("assistant", "x")]}
    assert chat.formatted(chat.chosen_paths(chat.linear(docs(spark, [], TURNS)))).count() == 0
