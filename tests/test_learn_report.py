import json

import pytest
from pyspark.sql import functions as F

from mailgrain.operators import learn as L
from mailgrain.operators import report as R

MAIL = (
    "message_id string, seq long, sender string, subject string, date_received timestamp, body_text string, "
    "headers map<string,string>, has_attachment boolean"
)


def mails(spark, rows):
    from datetime import datetime

    full = [
        (f"m{i}", i, r.get("sender", "a@b.c"), r.get("subject", ""), datetime(2025, 1, 1, r.get("hour", 12)),
         r.get("body", ""), r.get("headers", {}), r.get("file", False))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, MAIL)


def test_counts_once_per_message(spark):
    rows = [
        {"subject": "re: RE: sale offer", "body": "loan loan http://a http://b http://c", "headers": {"From": "x", "from": "y"}},
        {"subject": "", "body": "", "file": True, "sender": ""},
    ]
    got = {(r["category"], r["pattern"]): r["n"] for r in L.pattern_counts(mails(spark, rows)).collect()}
    assert got == {
        ("headers", "from"): 1,
        ("keywords", "loan"): 1,
        ("patterns", "link"): 1,
        ("sender_patterns", "a@b.c"): 1,
        ("domain_patterns", "b.c"): 1,
        ("subject_patterns", "re:"): 1,
        ("subject_patterns", "marketing"): 1,
        ("time_patterns", "12"): 2,
        ("length_patterns", "short"): 2,
        ("link_patterns", "many"): 1,
        ("link_patterns", "none"): 1,
        ("attachment_patterns", "has_attachment"): 1,
        ("spacing_patterns", "sparse"): 2,
    }


def test_added_keyword_and_expression_are_counted(spark):
    added = [("keywords", "raffle", 0.9), ("patterns", "[A-Z]{3}-[0-9]+", 0.4), ("patterns", "curly_brackets", 0.1)]
    weights = L.default_weights(spark).unionByName(spark.createDataFrame(added, "category string, pattern string, weight double"))
    mail = mails(spark, [{"body": "Raffle ABC-1 http://a"}, {"body": "raffle abc-1 loan {x}"}, {}])
    counts = L.pattern_counts(mail, weights=weights).filter("category in ('keywords', 'patterns')")
    got = {(r["category"], r["pattern"]): r["n"] for r in counts.collect()}
    assert got == {
        ("keywords", "raffle"): 2,
        ("keywords", "loan"): 1,
        ("patterns", "[A-Z]{3}-[0-9]+"): 1,
        ("patterns", "curly_brackets"): 1,
        ("patterns", "link"): 1,
    }
    learned = L.learn_weights(L.pattern_counts(mail, weights=weights), mail).filter("pattern = 'raffle'").head()
    assert learned["weight"] == 1.0
    few = spark.createDataFrame(added[:1], "category string, pattern string, weight double")
    rest = L.pattern_counts(mail, weights=few).filter("category in ('keywords', 'patterns')").collect()
    assert [(r["pattern"], r["n"]) for r in rest] == [("raffle", 2)]


def test_pattern_with_colon(spark):
    got = {r["pattern"] for r in L.pattern_counts(mails(spark, [{"sender": "a:b:c <x>"}])).collect()}
    assert "a:b:c" in got


@pytest.mark.parametrize("hour, kept", [(5, True), (6, False), (22, False), (23, True), (0, True)])
def test_hours_that_weigh(spark, hour, kept):
    mail = mails(spark, [{"hour": hour}, {"hour": 12}])
    learned = L.learn_weights(L.pattern_counts(mail), mail).filter("category = 'time_patterns'").collect()
    assert [(r["pattern"], r["weight"]) for r in learned] == ([(str(hour), 1.0)] if kept else [])


def test_weights(spark):
    mail = mails(spark, [{"body": "Thanks"}] + [{"body": "x" * 81}] * 9)
    learned = {(r["category"], r["pattern"]): r["weight"] for r in L.learn_weights(L.pattern_counts(mail), mail).collect()}
    assert learned[("signature_patterns", "has_signature")] == 1 / 10 * 0.4
    assert learned[("spacing_patterns", "dense")] == 1.0
    assert learned[("sender_patterns", "a@b.c")] == 1.0
    assert ("link_patterns", "none") not in learned and ("length_patterns", "short") in learned
    headed = mails(spark, [{"headers": {"from": "x", "x-a": "y"}}])
    less = L.learn_weights(L.pattern_counts(headed), headed, exclude_headers=["from"])
    assert [r["pattern"] for r in less.filter("category = 'headers'").collect()] == ["x-a"]


def test_zone(spark):
    got = L.pattern_counts(mails(spark, [{"hour": 12}]), "America/New_York").filter("category = 'time_patterns'")
    assert got.head()["pattern"] == "7"


def test_save_and_load(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "category string, pattern string, weight double")
    path = str(tmp_path / "w")
    defaults = L.default_weights(spark)
    for version, weight in ((1, 0.1), (2, 0.2), (2, 0.3)):
        L.save_weights(frame([("keywords", "new", weight)]), path, "gmail", "a", version)
    saved = L.read_weights(spark, path)
    assert saved.count() == 2
    loaded = {(r["category"], r["pattern"]): r["weight"] for r in L.load_weights(defaults, saved, "gmail", "a").collect()}
    assert loaded[("keywords", "new")] == 0.3 and ("keywords", "loan") not in loaded
    assert loaded[("headers", "x-mailer")] == 0.7
    other = L.load_weights(defaults, saved, "gmail", "nobody")
    assert other.exceptAll(defaults).count() == 0 and other.count() == defaults.count()
    gone = L.overlay(defaults, frame([("domain_patterns", "d", 1.0)]), emptied=["headers", "keywords", "patterns"])
    assert gone.count() == 1
    L.write_weights_lines(frame([("keywords", "new", 0.5)]), str(tmp_path / "lines"), F.lit("2025-01-01"))
    line = spark.read.json(str(tmp_path / "lines")).head()
    assert (line["pattern"], line["weight"], line["version"]) == ("new", 0.5, "1.0")


def test_older_weight_files(spark, tmp_path):
    objects = {"weights": {"headers": {"from": 1}, "patterns": {r"\$\d+\.?\d*": 0.25, "odd+": 0.5}, "time_patterns": {}}}
    pairs = {"weights": {"patterns": [[r"\[.*?\]", 0.6]], "domain_patterns": {"a.b": 0.1}}, "version": "1.0"}
    for name, document in (("one", objects), ("two", pairs)):
        (tmp_path / name).write_text(json.dumps(document, indent=2))
    read = lambda name: {
        (r["category"], r["pattern"]): r["weight"] for r in L.read_weights_document(spark, str(tmp_path / name)).collect()
    }
    assert read("one") == {("headers", "from"): 1.0, ("patterns", "price"): 0.25, ("patterns", "odd+"): 0.5}
    assert read("two") == {("patterns", "square_brackets"): 0.6, ("domain_patterns", "a.b"): 0.1}


def test_sketched_counts(spark):
    stats = R.mailbox_stats_approx(R.analysed(mails(spark, [{"sender": f"u{i}@x.y"} for i in range(50)]))).head()
    assert stats["total_emails"] == 50 and abs(stats["unique_senders"] - 50) <= 2 and stats["unique_domains"] == 1


def test_tied_lists_keep_first_sight(spark):
    rows = [{"sender": s, "subject": t} for s, t in [("b", "zeta alpha"), ("a", "alpha zeta beta"), ("a", ""), ("b", "")]]
    analysed = R.analysed(mails(spark, rows))
    assert [(r["sender"], r["n"]) for r in R.top_senders(analysed).collect()] == [("b", 2), ("a", 2)]
    words = [(r["word"], r["n"]) for r in R.subject_keywords(analysed).collect()]
    assert words == [("zeta", 2), ("alpha", 2), ("beta", 1)]
    assert R.top_senders(analysed, 1).count() == 1


def test_empty_mailbox(spark):
    empty = R.analysed(mails(spark, [{}]).filter("1 = 0"))
    stats = R.mailbox_stats(empty)
    assert stats.head().asDict() == {
        "total_emails": 0, "human_emails": 0, "bot_emails": 0, "unique_senders": 0, "unique_domains": 0, "avg_length": 0.0
    }
    assert R.mailbox_percentages(stats).head()["bot_percent"] is None
    assert R.mailbox_profile(stats).head().asDict() == {"total_emails": 0, "bot_ratio": 0.0, "tier": "limited"}
    assert [r["n"] for r in R.hour_histogram(empty, spark).collect()] == [0] * 24


@pytest.mark.parametrize(
    "total, bots, tier", [(499, 499, "limited"), (500, 350, "balanced"), (500, 351, "high_bot"), (500, 0, "balanced")]
)
def test_tiers(spark, total, bots, tier):
    stats = spark.createDataFrame([(total, bots)], "total_emails long, bot_emails long")
    assert R.mailbox_profile(stats).head()["tier"] == tier


def test_whole_report(spark, tmp_path):
    rows = [{"sender": "noreply@x.y", "subject": "hello there", "headers": {"date": "1 Mar 2024 04:10"}}, {}]
    report = R.write_report(R.analysed(mails(spark, rows)), str(tmp_path / "r"))
    got = {(r["section"], r["key"]): (r["rank"], r["value"]) for r in report.collect()}
    assert got[("stats", "total_emails")] == (None, 2.0) and got[("stats", "bot_emails")] == (None, 1.0)
    assert got[("top_senders", "noreply@x.y")] == (1, 1.0) and got[("top_domains", "b.c")] == (2, 1.0)
    assert got[("bot_indicators", "noreply sender")] == (1, 1.0)
    assert got[("subject_keywords", "there")] == (2, 1.0) and got[("time_patterns", "4")] == (None, 1.0)
