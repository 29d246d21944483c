import pytest
from pyspark.sql import functions as F

from mailgrain.operators import classify as C


def mail(spark, body="", sender="a@b.com", headers=None, subject=""):
    row = [("m", "t", sender, subject, body, headers or {})]
    return spark.createDataFrame(
        row, "message_id string, thread_id string, sender string, subject string, body_text string, "
        "headers map<string,string>"
    )


def scored(spark, classify, *args, **kwargs):
    row = classify(mail(spark, *args, **kwargs)).head()
    return row["score"], row["is_bot"]


@pytest.mark.parametrize(
    "body, headers, expected",
    [
        ("x" * 1000, {}, (0.0, False)),
        ("x" * 1001, {}, (0.1, False)),
        ("a Loan", {}, (1.0, True)),
        ("loan" + "x" * 1001, {}, (1.0, True)),
        ("", {"X-Mailer": "y"}, (1.0, True)),
        ("", {"precedence": "bulk"}, (0.0, False)),
        ("", {"x-campaign-id": "y"}, (0.0, False)),
        ("555-123-4567", {}, (1.0, True)),
        ("$5", {}, (1.0, True)),
        ("$ 5", {}, (0.0, False)),
        ("https://a", {}, (1.0, True)),
        (None, {}, (0.0, False)),
    ],
)
def test_ratio(spark, body, headers, expected):
    assert scored(spark, C.classify_ratio, body, headers=headers) == expected


@pytest.mark.parametrize(
    "body, headers, expected",
    [
        ("", {}, (0.0, False)),
        ("unsubscribe", {}, (0.9, True)),
        ("unsubscribe newsletter", {}, ((0.9 + 0.7) / 2, True)),
        ("", {"X-PM-Origin": "y"}, (0.0, False)),
        ("", {"x-pm-transfer-encoding": "y"}, (0.6, True)),
        ("[a\nb]", {}, (0.0, False)),
        ("[a] {b}", {}, ((0.0 + 0.6 + 0.6) / 2, True)),
        ("x" * 2000, {}, (0.0, False)),
    ],
)
def test_mean(spark, body, headers, expected):
    assert scored(spark, C.classify_mean, body, headers=headers) == expected


@pytest.mark.parametrize(
    "body, headers, sender, expected",
    [
        ("click here", {}, "a", (0.3, False)),
        ("click here unsubscribe", {}, "a", (0.6, True)),
        ("http://a " * 5, {}, "a", (0.0, False)),
        ("http://a " * 6, {}, "a", (0.5, False)),
        ("", {"precedence": "Bulk mail"}, "a", (0.9, True)),
        ("", {"precedence": "list"}, "a", (0.0, False)),
        ("", {"x-marketing-a": "1", "x-campaign-b": "2"}, "a", (0.85, True)),
        ("", {}, "No-Reply auto@x", (0.85, True)),
        ("", {"list-unsubscribe": "", "auto-submitted": ""}, "a", (1.0, True)),
        (None, {}, "a", (0.0, False)),
    ],
)
def test_additive(spark, body, headers, sender, expected):
    score, bot = scored(spark, C.classify_additive, body, sender, headers)
    assert (pytest.approx(score), bot) == expected


def test_indicators(spark):
    rows = C.classify_additive(mail(spark, "http://a " * 7 + "Special Offer unsubscribe", "noreply@x", {"auto-submitted": "y"}))
    row = rows.head()
    assert row["indicators"] == ["auto-submitted", "noreply sender", "unsubscribe", "special offer", "7 URLs"]
    assert row["indicator_groups"][-1] == "many_urls"
    explained = C.explain_weights(mail(spark, "loan https://x", headers={"X-Mailer": "y"})).head()["matched"]
    assert [(m["category"], m["pattern"], m["weight"]) for m in explained] == [
        ("headers", "x-mailer", 0.7),
        ("keywords", "loan", 0.9),
        ("patterns", "link", 0.6),
    ]


@pytest.mark.parametrize("score, band", [(0.29, "low"), (0.3, "uncertain"), (0.69, "uncertain"), (0.7, "high")])
def test_band(one, score, band):
    assert one(C.confidence_band, score) == band


def test_learned(spark):
    rows = [("m1", "loan", {"from": "a"}), ("m2", "x" * 1001, {"zzz": "b"}), ("m3", "", {})]
    frame = spark.createDataFrame(rows, "message_id string, body_text string, headers map<string,string>")
    weights = spark.createDataFrame(
        [("headers", "from", 1.0), ("keywords", "loan", 0.2), ("time_patterns", "3", 0.9)],
        "category string, pattern string, weight double",
    )
    out = {r["message_id"]: r for r in C.classify_learned(frame, weights).collect()}
    assert (out["m1"]["ratio_score"], out["m1"]["mean_score"], out["m1"]["hits"]) == (1.0, (1.0 + 0.2) / 2, 2)
    assert (out["m2"]["ratio_score"], out["m2"]["mean_score"], out["m2"]["ratio_bot"]) == (0.1, 0.0, False)
    assert (out["m3"]["ratio_score"], out["m3"]["hits"]) == (0.0, 0)


def test_importance_and_unsubscribe(spark):
    rows = [("1", "t1", "boss@x", "", ""), ("2", "t2", "b", "URGENT", ""), ("3", "t3", "c", "", ""), ("4", "t3", "c", "", "")]
    frame = spark.createDataFrame(
        [*rows, ("5", "t5", "d", "", ""), ("6", None, None, "", "")],
        "message_id string, thread_id string, sender string, subject string, body_text string",
    )
    known = spark.createDataFrame([("boss@x",), ("boss@x",)], "sender string")
    out = {r["message_id"]: r["is_important"] for r in C.flag_importance(frame, known).collect()}
    assert out == {"1": True, "2": True, "3": True, "4": True, "5": False, "6": False}
    bot = mail(spark, "", headers={"list-unsubscribe": "<mailto:a@b>, <https://c/d>"}).withColumn("is_bot", F.lit(True))
    assert [(r["target"], r["method"]) for r in C.unsubscribe_targets(bot).collect()] == [
        ("mailto:a@b", "mail"),
        ("https://c/d", "web"),
    ]
    assert C.unsubscribe_targets(bot.withColumn("is_bot", F.lit(False))).count() == 0
