"""Pieces of the comparison SQL: the views, and plain-SQL forms of features and scores."""

from __future__ import annotations

from mailgrain.plans import views as V

ISO = "'%Y-%m-%d %H:%M:%S.%f'"
HEADERS = "'from,received,to,subject,date"

# Body and header facts the provider export is built from, in plain SQL.
MAIL = f"""mail AS (SELECT *, make_timestamp(epoch_s * 1000000) AS date_received,
  lower(body_text) AS low, lower(subject) AS low_subject,
  CASE header_kind WHEN 'bulk' THEN {HEADERS},list-unsubscribe,precedence'
    WHEN 'campaign' THEN {HEADERS},x-campaign-id,auto-submitted' ELSE {HEADERS},cc' END AS header_names,
  CASE WHEN header_kind <> 'plain' THEN '' ELSE cc_header END AS cc,
  length(body_text) AS body_length,
  CASE WHEN seq % 8 IN (2, 3, 5) THEN NULL ELSE hour_sent END AS hour_written,
  CASE WHEN contains(sender, '@') THEN rtrim(ltrim(string_split(sender, '@')[-1], '>'), '>') ELSE '' END
    AS domain_report
  FROM ({V.MAIL_SQL}) v)"""


def in_two_accounts(table: str, number: str, others: str = "message_id") -> str:
    """``table`` with its rows dealt to two accounts that share their message ids; ``others`` are the columns to replace."""
    return f"""(SELECT * EXCLUDE ({others}), concat('acct-', {number} % 2) AS account,
      {V._KEY.format(f'{number} - {number} % 2')} AS message_id FROM {table})"""


def count_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


LINK = "https?://[!$-_a-z]+"
KEYWORDS = [
    "unsubscribe", "newsletter", "marketing", "subscription", "loan",
    "mortgage", "credit", "promotion", "special offer", "click here",
]
PATTERNS = {"link": LINK, "phone": "[0-9]{3}-[0-9]{3}-[0-9]{4}", "price": r"\$\d"}
AUTOMATED = any_of("lower(sender)", ["noreply", "no-reply", "donotreply", "auto@"])
PHRASES = ["unsubscribe", "click here", "special offer", "limited time"]


def ratio_hit(body: str) -> str:
    regexes = " OR ".join(f"regexp_matches({body}, '{p}')" for p in PATTERNS.values())
    return f"(header_kind IN ('bulk', 'campaign') OR {any_of(f'lower({body})', KEYWORDS)} OR {regexes})"


def ratio_score(body: str) -> str:
    return (
        f"least((CASE WHEN {ratio_hit(body)} THEN 1::DOUBLE ELSE 0::DOUBLE END)"
        f" + (CASE WHEN length({body}) > 1000 THEN 0.1::DOUBLE ELSE 0::DOUBLE END), 1::DOUBLE)"
    )


_PHRASE_COUNT = " + ".join(f"contains(low, '{p}')::INT" for p in PHRASES)
_PHRASE_LABELS = ", ".join(f"CASE WHEN contains(low, '{p}') THEN '{p}' END" for p in PHRASES)
_LABELS = f"""CASE WHEN header_kind = 'bulk' THEN 'list-unsubscribe' END,
  CASE WHEN header_kind = 'bulk' THEN 'precedence: bulk' END,
  CASE WHEN header_kind = 'campaign' THEN 'marketing headers' END,
  CASE WHEN header_kind = 'campaign' THEN 'auto-submitted' END,
  CASE WHEN {AUTOMATED} THEN 'noreply sender' END, {_PHRASE_LABELS}"""

ADDITIVE = f"""{MAIL}, additive AS (
  SELECT *, least(total, 1::DOUBLE) AS score, total > 0.5::DOUBLE AS is_bot,
    concat_ws('|', {_LABELS}, CASE WHEN urls > 5 THEN concat(urls, ' URLs') END) AS indicators,
    concat_ws('|', {_LABELS}, CASE WHEN urls > 5 THEN 'many_urls' END) AS indicator_groups
  FROM (SELECT *, (CASE WHEN header_kind = 'bulk' THEN 0.8::DOUBLE ELSE 0::DOUBLE END)
      + (CASE WHEN header_kind = 'bulk' THEN 0.9::DOUBLE ELSE 0::DOUBLE END)
      + (CASE WHEN header_kind = 'campaign' THEN 0.85::DOUBLE ELSE 0::DOUBLE END)
      + (CASE WHEN header_kind = 'campaign' THEN 0.9::DOUBLE ELSE 0::DOUBLE END)
      + (CASE WHEN {AUTOMATED} THEN 0.85::DOUBLE ELSE 0::DOUBLE END)
      + ({_PHRASE_COUNT}) * 0.3::DOUBLE
      + (CASE WHEN urls > 5 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS total
    FROM (SELECT *, {count_of('body_text', 'https?://')} AS urls FROM mail) u) t)"""

LENGTH = "CASE WHEN body_length < 100 THEN 'short' WHEN body_length < 500 THEN 'medium' ELSE 'long' END"
_LINES = "len(string_split(body_text, chr(10)))"
LINE_MEAN = f"((body_length - ({_LINES} - 1))::DOUBLE / {_LINES}::DOUBLE)"
SPACING = f"CASE WHEN {LINE_MEAN} > 80 THEN 'dense' WHEN {LINE_MEAN} > 40 THEN 'normal' ELSE 'sparse' END"
_LINKS = count_of("body_text", LINK)
LINKS = f"CASE WHEN {_LINKS} = 0 THEN 'none' WHEN {_LINKS} < 3 THEN 'few' ELSE 'many' END"
DOMAIN_LEARN = "CASE WHEN contains(sender, '@') THEN lower(split_part(sender, '@', 2)) END"
NAME = "nullif(trim(split_part(sender, '<', 1)), '')"
SUBJECT_MARKERS = {
    "re:": "contains(low_subject, 're:')",
    "fw:": "contains(low_subject, 'fw:')",
    "marketing": any_of("low_subject", ["sale", "offer", "discount", "limited time"]),
}
CONTENT_MARKERS = {
    "unsubscribe": "contains(low, 'unsubscribe')",
    "click_here": "contains(low, 'click here')",
    "view_in_browser": "contains(low, 'view in browser')",
}
REPLY_MARKERS = {
    "quoted": "contains(body_text, '>')",
    "email_client": "contains(body_text, 'On ') AND contains(body_text, 'wrote:')",
}
SIGNATURE = any_of("body_text", ["--", "Best regards", "Thanks"])
PREVIEW = (
    "CASE WHEN length({0}) > {1} THEN concat(substr({0}, 1, {1}), '...') ELSE {0} END"
)
SQUEEZED = "trim(regexp_replace(body_text, '\\s+', ' ', 'g'))"


def labels(markers: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in markers.items()) + ")"


WINDOW = {24: "TIMESTAMP '2025-12-31' - INTERVAL 720 DAY", 12: "TIMESTAMP '2025-06-30' - INTERVAL 360 DAY"}
IN_WINDOW = f"date_received >= {WINDOW[24]} AND date_received <= TIMESTAMP '2025-12-31'"


def _rows(category: str, markers: dict[str, str]) -> list[str]:
    return [f"SELECT '{category}', '{name}' FROM history WHERE {cond}" for name, cond in markers.items()]


_PATTERN_ROWS = [
    "SELECT 'headers' AS category, unnest(string_split(header_names, ',')) AS pattern FROM history",
    *_rows("keywords", {k: f"contains(low, '{k}')" for k in KEYWORDS}),
    *_rows("patterns", {n: f"regexp_matches(body_text, '{p}')" for n, p in PATTERNS.items()}),
    f"SELECT 'sender_patterns', {NAME} FROM history WHERE {NAME} IS NOT NULL",
    *_rows("subject_patterns", SUBJECT_MARKERS),
    "SELECT 'time_patterns', CAST(hour(date_received) AS VARCHAR) FROM history",
    f"SELECT 'length_patterns', {LENGTH} FROM history",
    f"SELECT 'link_patterns', {LINKS} FROM history",
    f"SELECT 'domain_patterns', {DOMAIN_LEARN} FROM history WHERE contains(sender, '@')",
    *_rows("content_patterns", CONTENT_MARKERS),
    *_rows("reply_patterns", REPLY_MARKERS),
    *_rows("attachment_patterns", {"has_attachment": "has_attachment"}),
    f"SELECT 'spacing_patterns', {SPACING} FROM history",
    *_rows("signature_patterns", {"has_signature": SIGNATURE}),
]
COUNTS = f"""{MAIL}, history AS (SELECT * FROM mail WHERE {IN_WINDOW}),
counts AS (SELECT category, pattern, count(*) AS n FROM ({' UNION ALL '.join(_PATTERN_ROWS)}) p GROUP BY ALL)"""
LEARNED = f"""{COUNTS}, learned AS (SELECT category, pattern,
  least(1::DOUBLE, n::DOUBLE / (SELECT count(*) FROM history)::DOUBLE * CASE category
    WHEN 'sender_patterns' THEN 3::DOUBLE WHEN 'length_patterns' THEN 1.5::DOUBLE
    WHEN 'content_patterns' THEN 2.5::DOUBLE WHEN 'reply_patterns' THEN 0.5::DOUBLE
    WHEN 'attachment_patterns' THEN 0.3::DOUBLE WHEN 'spacing_patterns' THEN 1.5::DOUBLE
    WHEN 'signature_patterns' THEN 0.4::DOUBLE ELSE 2::DOUBLE END) AS weight
  FROM counts WHERE CASE category
    WHEN 'time_patterns' THEN CAST(pattern AS INT) < 6 OR CAST(pattern AS INT) > 22
    WHEN 'length_patterns' THEN pattern IN ('short', 'long')
    WHEN 'link_patterns' THEN pattern = 'many'
    WHEN 'spacing_patterns' THEN pattern = 'dense' ELSE TRUE END)"""

FLAT = f"flat AS (SELECT *, make_timestamp(epoch_s * 1000000) AS date_received FROM ({V.FLAT_SQL}) f)"
UPDATES = f"""latest AS (SELECT * FROM ({V.UPDATES_SQL}) u
  QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY update_seq DESC) = 1),
feedback AS ({V.FEEDBACK_SQL})"""
