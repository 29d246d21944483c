import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from mailgrain.llm import secret_scan as S
from tests.llm.helpers import docs

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
SCHEMA = "doc_id long, text string, source string"


def brute(text):
    out = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def scan(spark, rows, schema=SCHEMA):
    out = S.scanned(docs(spark, rows, schema), ["doc_id"])
    return out.select("doc_id", S.written(F.col("spans"), True).alias("base"), S.written(F.col("spans")).alias("all"), "spans")


def test_base_spans(spark):
    hexes = hashlib.sha256(b"x").hexdigest()
    texts = [
        "password=abcdef token: 'qwerty-1' SECRET = \"aa\"", "token=secret:abcdefgh", "token:token:abcdefg", "api_key==x apikey=1234567",
        f"é😀 {hexes} AKIA{'A' * 16}", "AKIAAKIA" + "B" * 15 + " AKIA" + "C" * 15, "pass" * 3 + "word=abcdefgh" * 3, hexes * 400,
        "tokenpasswd='x.y.z=1'token =\tzzzzzzz", "Api-Key=12345678 API_KEY\"  :  \"12345678", "token=" + "a" * 23 + " " + "f" * 24, "K=ſecret=abcdefg",
    ]
    got = {r["doc_id"]: r["base"] for r in scan(spark, [(i, t, "s") for i, t in enumerate(texts)]).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_ownership(spark):
    wide, own, weak, bare = "Xy12Zw34Qr56Tu78Pk90", "Ab3dEf6hIj9kLm2nOp5q", "aaaaaaaaaaaa", "Zz9Yy8Xx7Ww6Vv5Uu4Tt3"
    rows = [(i, f"token={wide}", f"s{i}") for i in range(4)] + [(10, f"token={own}", "s"), (11, f"token={own}", "s")]
    rows += [(12, f"token={weak}", "s"), (13, f"see {bare} there", "s"), (14, f"or {wide} bare", "s")]
    out = {r["doc_id"]: r for r in scan(spark, rows).collect()}
    classes = {i: [s["class"] for s in r["spans"]] for i, r in out.items()}
    assert classes[0] == ["copied"] and classes[10] == ["live"] and classes[12] == ["weak"]
    assert out[10]["spans"][0]["repositories"] == 2 and out[10]["spans"][0]["owners"] == 1
    assert out[13]["all"] == f"bare:4:{4 + len(bare)}" and out[13]["base"] == "" and out[14]["all"] == ""


def test_masked(spark):
    text = "a token=0123456789abcdef0123456789abcdef z AKIA" + "Q" * 16 + " end"
    out = S.scanned(docs(spark, [(1, text, "s"), (2, "none", "s"), (3, None, "s")], SCHEMA), ["doc_id", "text"])
    got = {r["doc_id"]: r["m"] for r in out.select("doc_id", S.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {1: "a [SECRET] z [SECRET] end", 2: "none", 3: None}


def test_nulls_repeats_extra_columns_and_empty_table(spark):
    rows = [(None, "token=abcdefgh", None, 1), (1, None, "s", 1), (1, "token=abcdefgh", "s", 2), (1, "token=abcdefgh", "s", 2), (2, "", "s", 3)]
    out = scan(spark, rows, SCHEMA + ", spans int").collect()
    assert sorted((str(r["doc_id"]), r["all"]) for r in out) == sorted(
        [("None", "assign:0:14"), ("1", ""), ("1", "assign:0:14"), ("1", "assign:0:14"), ("2", "")]
    )
    assert scan(spark, []).count() == 0


def masks(text):
    """The text with every group of overlapping base spans masked, by a plain loop."""
    out, at = "", 0
    for a, b in sorted((m.start(), m.end()) for _, p, g, n in BASE for m in p.finditer(text) if len(m.group(g)) >= n):
        if a >= at:
            out += text[at:a] + S.MASK
        at = max(at, b)
    return out + text[at:]


def test_long_texts_with_many_spans(spark):
    """Overlaps, blocks cut anywhere, characters beyond the first plane; the time grows with the spans, not their square."""
    rng, seconds = random.Random(4), {}
    bits = ["token=", "abcdef", hashlib.md5(b"y").hexdigest(), " ", "😀é ", "AKIA" + "Z" * 20, "\n", "x" * 900, "secret: "]
    for n in (2_000, 20_000):
        texts = ["".join(rng.choices(bits, k=n)) for _ in range(2)] + [(hashlib.md5(b"z").hexdigest() + " ") * n, "é" * 4096, "😀" * 8192 + "token=abcdefg"]
        rows = [(i, t, "s") for i, t in enumerate(texts)]
        start = time.monotonic()
        out = S.scanned(docs(spark, rows, SCHEMA), ["doc_id", "text"])
        got = out.select("doc_id", S.written(F.col("spans"), True).alias("base"), S.masked(F.col("text"), F.col("spans")).alias("m")).collect()
        seconds[n] = time.monotonic() - start
        assert {r["doc_id"]: r["base"] for r in got} == {i: brute(t) for i, t, _ in rows}
        bare = S.scanned(docs(spark, rows, SCHEMA), ["doc_id"]).filter(F.exists("spans", lambda s: s["kind_no"] == 3)).count()
        assert bare == 0 and {r["doc_id"]: r["m"] for r in got} == {i: masks(t) for i, t, _ in rows}
    assert seconds[20_000] < 30 * seconds[2_000]
