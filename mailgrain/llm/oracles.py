"""SQL for the rows of the named queries, as DuckDB runs it. Where it is missing, tests compare with plain Python."""

from __future__ import annotations

from mailgrain.llm import chat, secret_scan

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda v: v <> '')"
_SHINGLES = """CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""

OP1 = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM dw),
b AS (SELECT item_id, unnest(own) AS s, len(own) AS n FROM (SELECT item_id, {_SHINGLES} AS own FROM bw WHERE len(w) >= 5)),
small AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM bw WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / n AS containment
FROM d JOIN b USING (s) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0::DOUBLE FROM dw JOIN small ON contains(' ' || array_to_string(w, ' ') || ' ', s)"""

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
own AS (SELECT doc_id, list_sort({_SHINGLES}) AS own FROM w),
kind AS (SELECT min(doc_id) AS k, own FROM own WHERE len(own) > 0 GROUP BY own),
each AS (SELECT k, len(own) AS n, unnest(own) AS s FROM kind),
link AS (SELECT a.k AS a, b.k AS b FROM each a JOIN each b ON a.s = b.s AND a.k < b.k
    GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT k AS a, k AS b FROM kind UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
root AS (SELECT a AS k, min(b) AS component_id FROM reach GROUP BY a)
SELECT o.doc_id, CAST(len(o.own) AS BIGINT) AS n_shingles, coalesce(r.component_id, o.doc_id) AS component_id,
    o.doc_id = coalesce(r.component_id, o.doc_id) AS kept
FROM own o LEFT JOIN kind ON kind.own = o.own LEFT JOIN root r ON r.k = kind.k"""


def _found(kind: str) -> str:
    pattern, group, least = {**secret_scan.BASE, "bare": (secret_scan.BARE, 0, 20)}[kind]
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, {secret_scan.KINDS.index(kind)} AS kind_no, start, start + length(whole) AS stop, value
FROM (SELECT doc_id, source, m[i] AS whole, v[i] AS value,
        list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (SELECT doc_id, source, g, m, v, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, source, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m,
                regexp_extract_all(text, '{pattern}', {group}) AS v FROM documents WHERE regexp_matches(text, '{pattern}'))))
WHERE length(value) >= {least}"""


OP4 = f"""
WITH base AS ({' UNION ALL '.join(_found(k) for k in secret_scan.BASE)}),
bare AS (SELECT * FROM ({_found('bare')}) c WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
    AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start < c.stop AND c.start < b.stop)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM found GROUP BY value),
named AS (SELECT f.*, list_value('{"', '".join(secret_scan.KINDS)}')[kind_no + 1] || ':' || start || ':' || stop AS span,
        CASE WHEN owners >= {secret_scan.WIDE_OWNERS} THEN 'copied'
            WHEN len(list_distinct(string_split(lower(value), ''))) >= {secret_scan.LEAST_DIFFERENT} THEN 'live' ELSE 'weak' END AS class
    FROM found f JOIN owned USING (value)),
kept AS (SELECT * FROM named WHERE kind_no < {len(secret_scan.BASE)} OR class = 'live'),
per AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
        count(*) FILTER (kind_no = 2) AS n_hex,
        string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(secret_scan.BASE)}) AS base,
        string_agg(span, ',' ORDER BY start, kind_no) AS spans,
        count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'copied') AS n_copied
    FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_copied, 0) AS n_copied
FROM documents LEFT JOIN per USING (doc_id)"""

OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM p LEFT JOIN f USING (payload_digest)"""


def _marks_length() -> str:
    known = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in chat.MARKS.items())
    return f"CASE role {known} ELSE {len(chat.OTHER.format('')) + len(chat.OTHER_END)} + {_escaped_length('role')} END"


def _escaped_length(column: str) -> str:
    return f"length(regexp_replace({column}, '[\\\\\\[\\]<]', '..', 'g'))"


OP8 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum({_escaped_length('text')} + {_marks_length()}) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c"""

OP11 = r"""
WITH w AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
n AS (SELECT side, doc_id, word, count(*) AS n FROM w GROUP BY side, doc_id, word),
crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
    FROM range(256) r(i)),
each AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM n)),
bucket AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(1, len(h), 2), lambda p: CAST('0x' || h[p:p + 1] AS BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket FROM each, crc_table),
per AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM n JOIN bucket USING (word) GROUP BY bucket),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM per),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(per.t + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE)
        / (CAST(per.s + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM per, total),
doc AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM n JOIN bucket USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
            / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM documents LEFT JOIN doc USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM ranked"""

OP13 = """
WITH usable AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
        CAST(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""

ORACLES = {
    "op1_benchmark_decontamination": OP1,
    "op3_minhash_near_dedup": OP3,
    "op4_secret_scans": OP4,
    "op7_warc": OP7,
    "op8_chat_formatting": OP8,
    "op11_importance_resampling": OP11,
    "op13_hard_negatives": OP13,
}
