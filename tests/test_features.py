import pytest
from pyspark.sql import functions as F

from mailgrain.functions import features as X


@pytest.mark.parametrize(
    "sender, learn, report, store, name",
    [
        ("undisclosed", None, "", "", "undisclosed"),
        ("A <a@X.com>", "x.com>", "X.com", "X.com>", "A"),
        ('"x@y" <c@z.com>', 'y" <c', "z.com", 'y" <c', '"x@y"'),
        ("a@B.org", "b.org", "B.org", "B.org", "a@B.org"),
        ("", None, "", "", None),
        (" <a@b>", "b>", "b", "b>", None),
        ("\t Ann\n<a@>>", ">>", "", ">>", "Ann"),
    ],
)
def test_sender(one, sender, learn, report, store, name):
    assert one(X.sender_domain_learn, sender) == learn
    assert one(X.sender_domain_report, sender) == report
    assert one(X.sender_domain_store, sender) == store
    assert one(X.sender_name, sender) == name


@pytest.mark.parametrize("size, bucket", [(0, "short"), (99, "short"), (100, "medium"), (499, "medium"), (500, "long")])
def test_length(one, size, bucket):
    assert one(lambda b: X.length_bucket(F.length(b)), "é" * size) == bucket


@pytest.mark.parametrize(
    "body, mean, bucket",
    [
        ("", 0, "sparse"),
        ("x" * 40, 40, "sparse"),
        ("x" * 40 + "\n" + "x" * 41, 40.5, "normal"),
        ("x" * 80, 80, "normal"),
        ("x" * 80 + "\n" + "x" * 81, 80.5, "dense"),
        ("x\n", 0.5, "sparse"),
    ],
)
def test_spacing(one, body, mean, bucket):
    assert one(X.mean_line_length, body) == mean
    assert one(lambda b: X.spacing_bucket(X.mean_line_length(b)), body) == bucket


@pytest.mark.parametrize("links, bucket", [(0, "none"), (1, "few"), (2, "few"), (3, "many")])
def test_links(one, links, bucket):
    assert one(lambda b: X.link_bucket(X.link_count(b)), " http://a.b" * links) == bucket


def test_long_link(one):
    assert one(X.link_count, "https://" + "a%20(b)" * 3000) == 1
    assert one(X.link_count, "http:// https://é") == 0
    assert one(X.url_count, "http:// https://é") == 2


@pytest.mark.parametrize(
    "date, hour",
    [
        ("Tue, 01 Mar 2024 23:10:07 +0530", 23),
        ("1 Mar 2024 04:10", 4),
        ("Tue, 1 Mar 24 7:10:59 GMT", 7),
        ("Mon, 29 Feb 2024 10:00:00 -0800 (PST)", 10),
        ("Mon, 29 Feb 2023 10:00:00 -0800", None),
        ("Mon, 1 Jan 2024 24:00:00 +0000", None),
        ("Mon, 1 Jan 2024 10:60:00 +0000", None),
        ("Mon, 1 Jan 2024 10:00:60 +0000", None),
        ("Mon, 1 Jan 2024 10:00:00 +9900", None),
        ("Mon, 1 Foo 2024 10:00:00 +0000", None),
        ("a|b|c|d|e|f|g", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_hour_header(one, date, hour):
    assert one(X.hour_header, date) == hour


def test_markers(one):
    assert one(X.subject_markers, "RE: wholesale FW: x") == ["re:", "fw:", "marketing"]
    assert one(X.subject_markers, "Fwd: limited time") == ["marketing"]
    assert one(X.subject_markers, "hello") == []
    assert one(X.content_markers, "UNSUBSCRIBE Click Here") == ["unsubscribe", "click_here"]
    assert one(X.reply_markers, "On Monday A wrote:\n> x") == ["quoted", "email_client"]
    assert one(X.reply_markers, "on monday wrote:") == []
    assert one(X.signature_marker, "thanks") is False
    assert one(X.signature_marker, "Thanks") is True
    assert one(X.signature_marker, None) is False


def test_previews(one):
    assert one(X.mail_preview, "  a \n\t b  ") == "a b"
    assert one(X.mail_preview, "x" * 100) == "x" * 100
    assert one(X.mail_preview, "x" * 101) == "x" * 100 + "..."
    assert one(X.subject_preview, "y" * 51) == "y" * 50 + "..."


def test_words(one):
    assert one(X.subject_words, "  The QUICK quick, fox\tjumps ") == ["quick", "quick,", "jumps"]
    assert one(X.subject_words, "") == []


def test_hash(one):
    assert one(X.content_hash, "abc") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
