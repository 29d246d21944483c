"""Queries: classifiers, learning, the mailbox report."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailgrain.operators import classify as C
from mailgrain.operators import learn as L
from mailgrain.operators import report as R
from mailgrain.plans import oracle_parts as O
from mailgrain.plans import views as V
from mailgrain.plans.registry import joined, query
from mailgrain.session import shared_dir, stored
from mailgrain.sources import exports as E


def _as_of(text="2025-12-31 00:00:00"):
    return F.lit(text).cast("timestamp")


@query(
    "classify_ratio",
    f"""WITH {O.MAIL}, s AS (SELECT message_id, {O.ratio_score('body_text')} AS score FROM mail)
      SELECT message_id, score, score > 0.5 AS is_bot FROM s""",
)
def classify_ratio(spark, sf_dir):
    return C.classify_ratio(V.mail(spark, sf_dir)).select("message_id", "score", "is_bot")


_MEAN_TERMS = [
    ("h = 'x-pm-content-encryption'", 0.8),
    ("h = 'x-pm-origin'", 0.7),
    ("contains(lower(body_text), 'unsubscribe')", 0.9),
    ("contains(lower(body_text), 'click here')", 0.8),
    ("contains(lower(body_text), 'view in browser')", 0.7),
    ("contains(lower(body_text), 'marketing')", 0.8),
    ("contains(lower(body_text), 'newsletter')", 0.7),
    (f"regexp_matches(body_text, '{O.LINK}')", 0.7),
    (r"regexp_matches(body_text, '\[.*?\]')", 0.6),
    (r"regexp_matches(body_text, '\{.*?\}')", 0.6),
]
_MEAN_SUM = " + ".join(f"(CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END)" for c, w in _MEAN_TERMS)
_MEAN_HITS = " + ".join(f"({c})::INT" for c, _ in _MEAN_TERMS)


@query(
    "classify_mean",
    f"""WITH {O.MAIL}, {O.FLAT}, both_kinds AS (
      SELECT 'gmail' AS provider, message_id, body_text, '' AS h FROM mail UNION ALL
      SELECT 'protonmail', message_id, body_text,
        CASE WHEN role = 'assistant' THEN 'x-pm-origin' ELSE 'x-pm-content-encryption' END FROM flat),
      s AS (SELECT *, {_MEAN_SUM} AS total, {_MEAN_HITS} AS hits FROM both_kinds)
      SELECT provider, message_id, CASE WHEN hits = 0 THEN 0::DOUBLE ELSE total / hits::DOUBLE END AS score,
        CASE WHEN hits = 0 THEN FALSE ELSE total / hits::DOUBLE > 0.5::DOUBLE END AS is_bot FROM s""",
)
def classify_mean(spark, sf_dir):
    both = E.union_accounts(V.mail(spark, sf_dir), E.parse_flat(V.flat_export(spark, sf_dir), "flat"))
    return C.classify_mean(both).select("provider", "message_id", "score", "is_bot")


@query("classify_additive", f"WITH {O.ADDITIVE} SELECT message_id, score, is_bot FROM additive")
def classify_additive(spark, sf_dir):
    return C.classify_additive(V.mail(spark, sf_dir)).select("message_id", "score", "is_bot")


_WEIGHTED = [
    ("header_kind = 'bulk'", "headers:list-unsubscribe"),
    ("header_kind = 'campaign'", "headers:auto-submitted"),
    *[(f"contains(low, '{k}')", f"keywords:{k}") for k in O.KEYWORDS],
    *[(f"regexp_matches(body_text, '{p}')", f"patterns:{n}") for n, p in O.PATTERNS.items()],
]


@query(
    "explain_indicators",
    f"""WITH {O.ADDITIVE} SELECT message_id, indicators, indicator_groups,
      concat_ws('|', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _WEIGHTED)}) AS weights FROM additive""",
)
def explain_indicators(spark, sf_dir):
    both = C.explain_weights(C.classify_additive(V.mail(spark, sf_dir)))
    named = F.transform("matched", lambda m: F.concat_ws(":", m["category"], m["pattern"]))
    return both.select(
        "message_id",
        joined("indicators").alias("indicators"),
        joined("indicator_groups").alias("indicator_groups"),
        joined(named).alias("weights"),
    )


@query(
    "confidence_band",
    f"""WITH {O.ADDITIVE} SELECT message_id, CASE WHEN score < 0.3::DOUBLE THEN 'low'
      WHEN score < 0.7::DOUBLE THEN 'uncertain' ELSE 'high' END AS band FROM additive""",
)
def confidence_band(spark, sf_dir):
    scored = C.classify_additive(V.mail(spark, sf_dir))
    return scored.select("message_id", C.confidence_band(F.col("score")).alias("band"))


IMPORTANT = f"""{O.MAIL}, chains AS (SELECT account, thread_id, count(*) > 1 AS in_chain FROM mail GROUP BY 1, 2),
  important AS (SELECT m.*, sender IN (SELECT concat('bob@', lang, '.example.com') FROM documents) AS known_sender,
    {O.any_of("lower(concat(subject, ' ', body_text))", ["urgent", "meeting"])} AS has_word, in_chain
    FROM mail m JOIN chains USING (account, thread_id))"""


def important(spark, sf_dir):
    known = V.table(spark, sf_dir, "documents").select(F.concat_ws("", F.lit("bob@"), "lang", F.lit(".example.com")))
    mail = V.mail(spark, sf_dir)
    return mail, C.flag_importance(mail, known.toDF("sender"))


@query(
    "flag_importance",
    f"""WITH {IMPORTANT} SELECT 'gmail' AS provider, account, message_id, known_sender, has_word, in_chain,
      known_sender OR has_word OR in_chain AS is_important FROM important""",
)
def flag_importance(spark, sf_dir):
    return important(spark, sf_dir)[1]


@query(
    "unsubscribe_targets",
    f"""WITH {O.ADDITIVE} SELECT 'gmail' AS provider, account, message_id, sender, t.target, t.method FROM additive,
      (VALUES ('mailto:out@lists.example.com', 'mail'), ('https://lists.example.com/out?x=1', 'web')) t(target, method)
      WHERE header_kind = 'bulk' AND (is_bot OR {O.any_of('low', ['loan', 'mortgage', 'credit'])})""",
)
def unsubscribe_targets(spark, sf_dir):
    return C.unsubscribe_targets(C.classify_additive(V.mail(spark, sf_dir)))


def _history(spark, sf_dir):
    return L.in_window(V.mail(spark, sf_dir), _as_of())


def _learned(spark, sf_dir):
    history = _history(spark, sf_dir)
    return L.learn_weights(L.pattern_counts(history), history)


@query("pattern_counts", f"WITH {O.COUNTS} SELECT category, pattern, n FROM counts")
def pattern_counts(spark, sf_dir):
    return L.pattern_counts(_history(spark, sf_dir))


@query("learn_weights", f"WITH {O.LEARNED} SELECT category, pattern, weight FROM learned")
def learn_weights(spark, sf_dir):
    return _learned(spark, sf_dir)


_FLAT_LEARNED = f"""{O.FLAT}, tags AS (SELECT 'domain_patterns' AS category, {O.DOMAIN_LEARN} AS pattern FROM flat
    UNION ALL SELECT 'content_patterns', 'unsubscribe' FROM flat WHERE contains(lower(body_text), 'unsubscribe')),
  learned_flat AS (SELECT category, pattern,
    least(1::DOUBLE, count(*)::DOUBLE / (SELECT count(*) FROM flat)::DOUBLE * 2::DOUBLE) AS weight
    FROM tags WHERE pattern IS NOT NULL GROUP BY 1, 2)"""


def _learned_flat(spark, sf_dir):
    history = E.parse_flat(V.flat_export(spark, sf_dir), "flat")
    return L.learn_weights_flat(L.pattern_counts_flat(history), history)


@query("learn_weights_flat", f"WITH {_FLAT_LEARNED} SELECT category, pattern, weight FROM learned_flat")
def learn_weights_flat(spark, sf_dir):
    return _learned_flat(spark, sf_dir)


# A keyword and an expression that no default list holds.
_ADDED = [("keywords", "tion", 0.35), ("patterns", "[A-Z]{2,}!!", 0.45)]
_HITS = f"""hits AS (
  SELECT message_id, 'headers' AS category, unnest(string_split(header_names, ',')) AS pattern FROM mail
  {" ".join(f"UNION ALL SELECT message_id, 'keywords', '{k}' FROM mail WHERE contains(low, '{k}')" for k in O.KEYWORDS)}
  {" ".join(f"UNION ALL SELECT message_id, 'patterns', '{n}' FROM mail WHERE regexp_matches(body_text, '{p}')"
            for n, p in O.PATTERNS.items())}
  UNION ALL SELECT message_id, '{_ADDED[0][0]}', '{_ADDED[0][1]}' FROM mail WHERE contains(low, '{_ADDED[0][1]}')
  UNION ALL SELECT message_id, '{_ADDED[1][0]}', '{_ADDED[1][1]}' FROM mail WHERE regexp_matches(body_text, '{_ADDED[1][1]}')),
in_force AS (SELECT * FROM learned UNION ALL SELECT * FROM (VALUES {", ".join(f"('{c}', '{p}', {w}::DOUBLE)" for c, p, w in _ADDED)}) a),
sums AS (SELECT message_id, count(*) AS hits,
    list_reduce(list(weight ORDER BY h.category, h.pattern), lambda a, b: a + b) AS total
  FROM hits h JOIN in_force USING (category, pattern) GROUP BY message_id),
scored AS (SELECT 'gmail' AS provider, m.account, m.message_id, coalesce(hits, 0) AS hits,
    least((CASE WHEN total > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END)
      + (CASE WHEN body_length > 1000 THEN 0.1::DOUBLE ELSE 0::DOUBLE END), 1::DOUBLE) AS ratio_score,
    coalesce(total / hits::DOUBLE, 0::DOUBLE) AS mean_score
  FROM mail m LEFT JOIN sums s USING (message_id))"""


@query(
    "apply_learned",
    f"""WITH {O.LEARNED}, {_HITS} SELECT *, ratio_score > 0.5::DOUBLE AS ratio_bot, mean_score > 0.5::DOUBLE AS mean_bot
      FROM scored""",
)
def apply_learned(spark, sf_dir):
    path = shared_dir(spark, "weights")
    added = spark.createDataFrame(_ADDED, "category string, pattern string, weight double")
    L.save_weights(_learned(spark, sf_dir).unionByName(added), path, "gmail", "main", 1)
    weights = L.load_weights(L.default_weights(spark), L.read_weights(spark, path), "gmail", "main")
    return C.classify_learned(V.mail(spark, sf_dir), weights)


@query(
    "save_weights",
    f"WITH {O.LEARNED} SELECT 'gmail' AS provider, 'main' AS account, 2 AS version, * FROM learned",
)
def save_weights(spark, sf_dir):
    path = shared_dir(spark, "weights")
    learned = stored(_learned(spark, sf_dir), "learned")
    for version in (1, 2):
        L.save_weights(learned, path, "gmail", "main", version)
    return L.read_weights(spark, path).filter("version = 2")


_DEFAULTS = ", ".join(f"('{c}', '{p}', {w}::DOUBLE)" for c, t in C.RATIO_WEIGHTS.items() for p, w in t.items())


@query(
    "load_weights",
    f"""WITH {_FLAT_LEARNED}
      SELECT * FROM learned_flat UNION ALL SELECT * FROM (VALUES {_DEFAULTS}) d(category, pattern, weight)
      WHERE category NOT IN (SELECT category FROM learned_flat)""",
)
def load_weights(spark, sf_dir):
    path = shared_dir(spark, "weights")
    L.save_weights(_learned_flat(spark, sf_dir), path, "protonmail", "flat", 1)
    return L.load_weights(L.default_weights(spark), L.read_weights(spark, path), "protonmail", "flat")


def _analysed(spark, sf_dir):
    return R.analysed(V.mail(spark, sf_dir))


_STATS = f"""{O.ADDITIVE}, stats AS (SELECT count(*) AS total_emails, count(*) FILTER (NOT is_bot) AS human_emails,
  count(*) FILTER (is_bot) AS bot_emails, count(DISTINCT sender) AS unique_senders,
  count(DISTINCT domain_report) AS unique_domains,
  sum(body_length)::DOUBLE / count(*)::DOUBLE AS avg_length FROM additive)"""


@query("mailbox_stats", f"WITH {_STATS} SELECT * FROM stats")
def mailbox_stats(spark, sf_dir):
    return R.mailbox_stats(_analysed(spark, sf_dir))


@query(
    "mailbox_percentages",
    f"""WITH {_STATS} SELECT total_emails, human_emails * 100 // total_emails AS human_percent,
      bot_emails * 100 // total_emails AS bot_percent FROM stats""",
)
def mailbox_percentages(spark, sf_dir):
    return R.mailbox_percentages(R.mailbox_stats(_analysed(spark, sf_dir)))


@query(
    "mailbox_profile",
    f"""WITH {_STATS}, r AS (SELECT total_emails, bot_emails::DOUBLE / total_emails::DOUBLE AS bot_ratio FROM stats)
      SELECT *, CASE WHEN total_emails < 500 THEN 'limited' WHEN bot_ratio > 0.7::DOUBLE THEN 'high_bot'
        ELSE 'balanced' END AS tier FROM r""",
)
def mailbox_profile(spark, sf_dir):
    return R.mailbox_profile(R.mailbox_stats(_analysed(spark, sf_dir)))


def _top(column: str, size: int) -> str:
    return f"SELECT {column}, count(*) AS n FROM mail GROUP BY 1 ORDER BY n DESC, min(seq) LIMIT {size}"


@query("top_senders", f"WITH {O.MAIL} {_top('sender', 50)}")
def top_senders(spark, sf_dir):
    return R.top_senders(_analysed(spark, sf_dir))


@query("top_domains", f"WITH {O.MAIL} {_top('domain_report AS sender_domain', 50)}")
def top_domains(spark, sf_dir):
    return R.top_domains(_analysed(spark, sf_dir))


_INDICATORS = """SELECT seq, unnest(string_split({0}, '|')) AS item, generate_subscripts(string_split({0}, '|'), 1) AS place
  FROM additive WHERE {0} <> ''"""


@query(
    "indicator_counts",
    f"""WITH {O.ADDITIVE}, one AS ({_INDICATORS.format('indicators')}), grouped AS (
      {_INDICATORS.format('indicator_groups')})
      SELECT 'each' AS form, item AS indicator, count(*) AS n FROM one GROUP BY 2
      UNION ALL SELECT 'grouped', item, count(*) FROM grouped GROUP BY 2""",
)
def indicator_counts(spark, sf_dir):
    rows = _analysed(spark, sf_dir)
    each = R.indicator_counts(rows).withColumn("form", F.lit("each"))
    return each.unionByName(R.indicator_counts(rows, grouped=True).withColumn("form", F.lit("grouped")))


_PLACED = """words AS (SELECT seq, u.word, u.place FROM (SELECT seq, list_filter(
    regexp_split_to_array(trim(low_subject), '\\s+'), lambda w: length(w) > 3) AS ws FROM mail) m,
  LATERAL (SELECT unnest(m.ws) AS word, generate_subscripts(m.ws, 1) AS place) u)"""
_TOP_WORDS = """SELECT word, count(*) AS n FROM words GROUP BY 1
  ORDER BY n DESC, min(seq * 10000000000 + place) LIMIT 100"""


@query("subject_keywords", f"WITH {O.MAIL}, {_PLACED} {_TOP_WORDS}")
def subject_keywords(spark, sf_dir):
    return R.subject_keywords(_analysed(spark, sf_dir))


@query(
    "hour_histogram",
    f"""WITH {O.MAIL}, h AS (SELECT hour_written AS hour, count(*) AS n FROM mail GROUP BY 1)
      SELECT r.range AS hour, coalesce(n, 0) AS n, coalesce(n, 0) // 10 AS bar
      FROM range(24) r LEFT JOIN h ON h.hour = r.range""",
)
def hour_histogram(spark, sf_dir):
    return R.hour_histogram(_analysed(spark, sf_dir), spark)


def _ranked(section: str, rows: str) -> str:
    return f"""SELECT '{section}' AS section, row_number() OVER (ORDER BY n DESC, first_at) AS rank, key,
      n::DOUBLE AS value FROM ({rows}) q"""


@query(
    "write_report",
    f"""WITH {_STATS}, {_PLACED}, ind AS ({_INDICATORS.format('indicators')})
      {_ranked('top_senders', "SELECT sender AS key, count(*) AS n, min(seq) AS first_at FROM mail GROUP BY 1")}
        QUALIFY rank <= 50
      UNION ALL {_ranked('top_domains',
        "SELECT domain_report AS key, count(*) AS n, min(seq) AS first_at FROM mail GROUP BY 1")} QUALIFY rank <= 50
      UNION ALL {_ranked('bot_indicators',
        "SELECT item AS key, count(*) AS n, min(seq * 10000000000 + place) AS first_at FROM ind GROUP BY 1")}
      UNION ALL {_ranked('subject_keywords',
        "SELECT word AS key, count(*) AS n, min(seq * 10000000000 + place) AS first_at FROM words GROUP BY 1")}
        QUALIFY rank <= 100
      UNION ALL SELECT 'time_patterns', NULL, CAST(hour_written AS VARCHAR), count(*)::DOUBLE FROM mail
        WHERE hour_written IS NOT NULL GROUP BY 3
      UNION ALL SELECT CASE WHEN name = 'avg_length' THEN 'content_stats' ELSE 'stats' END, NULL, name, value
        FROM (SELECT total_emails::DOUBLE AS total_emails, human_emails::DOUBLE AS human_emails,
          bot_emails::DOUBLE AS bot_emails, unique_senders::DOUBLE AS unique_senders,
          unique_domains::DOUBLE AS unique_domains, avg_length FROM stats) UNPIVOT (value FOR name IN (*))""",
)
def write_report(spark, sf_dir):
    return R.write_report(_analysed(spark, sf_dir), shared_dir(spark, "report"))
