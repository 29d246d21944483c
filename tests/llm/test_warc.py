import base64
import gzip
import hashlib
import io
import random

import pytest

from mailgrain.llm import warc, warc_bytes as B
from mailgrain.session import shared_dir
from tests.llm.helpers import docs, read

PAGES = "page_id long, url string, html string"


def trip(spark, rows, schema=PAGES, range_bytes=warc.RANGE_BYTES):
    archives = warc.write_archives(docs(spark, rows, schema), shared_dir(spark, "warc"))
    return archives, warc.read_archives(archives, range_bytes).collect()


@pytest.mark.parametrize("range_bytes", [97, 1000, 1 << 20])
def test_ranges_own_each_record_once(spark, range_bytes):
    rows = read("pages", "page_id, url, html")[:120 if range_bytes < 100 else None]
    archives, out = trip(spark, rows, range_bytes=range_bytes)
    assert sum(r["records"] for r in archives.collect()) == len(rows)
    html = {i: h for i, _, h in rows}
    assert sorted(r["page_id"] for r in out) == sorted(html) and all(r["intact"] for r in out)
    assert all(r["payload"].decode() == html[r["page_id"]] for r in out if r["record_type"] == "response")
    assert all(r["url"] == u for r in out for i, u, _ in rows if i == r["page_id"])


def test_archives_are_plain_gzip(spark):
    archives, _ = trip(spark, [(i, "http://a", "x" * 50 + str(i)) for i in range(20)])
    for row in archives.collect():
        with gzip.open(row["path"].removeprefix("file://")) as file:
            assert file.read().count(b"WARC/1.0\r\n") == row["records"]


def test_revisits_nulls_repeats_and_extra_columns(spark):
    same, short = "s" * 100, "s" * 99
    rows = [
        (5, "u5", same, 1), (3, "u3", same, 1), (9, None, same, 1), (9, None, same, 1), (3, "u3", same, 1), (None, "n", same, 1),
        (1, "a\r\nb", short, 1), (2, "c", short, 1), (4, "d", None, 1), (6, "e", "", 1),
    ]
    _, out = trip(spark, rows, PAGES + ", refers_to int")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out), key=str)
    assert got == sorted(
        [
            (5, "revisit", 3, 100), (3, "response", None, 100), (9, "revisit", 3, 100), (9, "revisit", 3, 100), (3, "response", None, 100),
            (None, "response", None, 100), (1, "response", None, 99), (2, "response", None, 99), (4, "response", None, 0), (6, "response", None, 0),
        ],
        key=str,
    )
    digest = hashlib.sha256(same.encode()).hexdigest()
    assert {r["payload_digest"] for r in out if r["payload_bytes"] == 100} == {digest}


@pytest.mark.parametrize("range_bytes", [1 << 19, warc.RANGE_BYTES])
def test_a_long_url_is_read_back(spark, range_bytes):
    url = "http://a/" + base64.b64encode(random.Random(7).randbytes(1_500_000)).decode()
    rows = [(1, "http://a", "x"), (2, url, "y"), (3, "http://b", "z")]
    archives, out = trip(spark, rows, range_bytes=range_bytes)
    assert sum(r["records"] for r in archives.collect()) == 3
    assert sorted((r["page_id"], r["url"], r["payload"].decode(), r["intact"]) for r in out) == [(*r, True) for r in rows]


def test_empty_table(spark):
    archives, out = trip(spark, [])
    assert archives.count() == 0 and out == []


def source(data):
    return B.Bytes(io.BytesIO(data), len(data))


def test_magic_inside_records_and_damage_are_passed_over():
    rng = random.Random(3)
    first = B.record(1, "u", bytes(rng.randrange(256) for _ in range(3000)) + B.MAGIC * 40, None, "d")
    inner = B.record(2, "u", b"x", None, "d")
    second = B.record(3, "u", b"y" * 200, None, "d")
    data = first + b"\x00garbage" + B.MAGIC + b"no member" + inner + second
    for step in (1, 7, 500, len(data)):
        found = [p for a in range(0, len(data), step) for p, _, _ in B.records(source(data), a, min(a + step, len(data)))]
        assert found == [0, data.index(inner), data.index(second)]
    assert list(B.records(source(first[:-5]), 0, len(first))) == []


def test_long_records(spark):
    _, out = trip(spark, [(1, "u", "long " * 700_000), (2, "u", "é" * 90)], range_bytes=1 << 12)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in out) == [(1, 3_500_000), (2, 180)]
