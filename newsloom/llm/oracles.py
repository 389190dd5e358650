"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op7_exact_dedup"] = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
    FROM documents
), g AS (
    SELECT body, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""

ORACLES["op9_warc_round_trip"] = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
    FROM pages
), b AS (
    SELECT page_id, last_id, strlen(body) AS payload_bytes,
           ('0x' || sha1(body)) AS h, sha1(body) AS hex
    FROM p
)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                 (('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) % 32 + 1, 1), '' ORDER BY i)
        FROM range(32) r(i)) AS payload_digest,
       CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM b
"""

_CRC_STEP = "list_transform({}, lambda x: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_CRC_TABLE = "range(256)"
for _ in range(8):
    _CRC_TABLE = _CRC_STEP.format(_CRC_TABLE)

# Viterbi by recursion; edits and text of a row are carried whole, no tree
ORACLES["op13_conversation_repair"] = (
    r"""
WITH RECURSIVE crc AS (
    SELECT """
    + _CRC_TABLE
    + r""" AS tab
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                          lambda c: ord(c)::BIGINT) AS bytes
    FROM conversations
), hit AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce(list_concat([4294967295::BIGINT], bytes),
                           lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS h
    FROM keyed, crc
), broken AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
           CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM hit WHERE h <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           rtrim(text, E' \t\n\x0b\x0c\r') AS body
    FROM broken
), r AS (
    SELECT *, CASE WHEN body = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
           lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two
    FROM numbered
), ins(state, n, marks, lines, there) AS (
    VALUES (0, 0, '', NULL, 0), (1, 0, '', NULL, 1), (2, 0, '', NULL, 2), (3, 0, '', NULL, 3),
           (0, 1, 'I', 'user:', 2), (1, 1, 'I', 'user:', 2), (2, 1, 'I', 'assistant:', 3), (3, 1, 'I', 'user:', 2),
           (0, 2, 'II', E'user:\nassistant:', 3), (1, 2, 'II', E'user:\nassistant:', 3)
), ops(state, op, letter, there, role, price) AS (
    VALUES (0, 'D', NULL, 0, NULL, 2), (1, 'D', NULL, 1, NULL, 2), (2, 'D', NULL, 2, NULL, 2), (3, 'D', NULL, 3, NULL, 2),
           (0, 'K', 's', 1, NULL, 0), (0, 'K', 'u', 2, NULL, 0), (1, 'K', 'u', 2, NULL, 0), (3, 'K', 'u', 2, NULL, 0),
           (2, 'K', 'a', 3, NULL, 0), (0, 'R', NULL, 2, 'user', 1), (1, 'R', NULL, 2, 'user', 1), (3, 'R', NULL, 2, 'user', 1),
           (2, 'R', NULL, 3, 'assistant', 1)
), moves AS (
    SELECT ins.state, n, marks, lines, op, letter, ops.there, role, price FROM ins JOIN ops ON ops.state = ins.there
), v AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0 AS cost, '' AS audit, NULL::VARCHAR AS whole FROM conversations
    UNION ALL
    SELECT conv_id, i, there, min(cost), arg_min(audit, (cost, audit)), arg_min(coalesce(whole, chr(1)), (cost, audit))
    FROM (
        SELECT v.conv_id, r.i, m.there, v.audit || m.marks || m.op AS audit,
               v.cost + 5 * m.n + m.price + CASE WHEN r.fault = 'truncated' AND m.op <> 'D' THEN 5 ELSE 0 END AS cost,
               concat_ws(E'\n', nullif(v.whole, chr(1)), m.lines,
                         CASE WHEN m.op <> 'D' THEN coalesce(m.role, r.role) || ':' || r.text END) AS whole0,
               CASE WHEN nullif(v.whole, chr(1)) IS NULL AND m.lines IS NULL AND m.op = 'D' THEN NULL ELSE whole0 END AS whole
        FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1
        JOIN moves m ON m.state = v.state AND (m.letter IS NULL OR m.letter = left(r.role, 1))
             AND (m.op = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
    ) GROUP BY conv_id, i, there
), counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY conv_id
), ended AS (
    SELECT v.conv_id, min(v.cost + 5 * ins.n)::BIGINT AS cost,
           arg_min(audit || marks, (v.cost + 5 * ins.n, audit || marks)) AS audit,
           arg_min(concat_ws(E'\n', nullif(whole, chr(1)), lines), (v.cost + 5 * ins.n, audit || marks)) AS whole
    FROM v LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM v.conv_id
    JOIN ins ON ins.state = v.state AND ins.there IN (0, 3)
    WHERE v.i = coalesce(c.n, 0) GROUP BY v.conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
)

ORACLES["op12_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT doc, lang, source,
           unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
                                 lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
    FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), v AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (
    SELECT DISTINCT lang, source FROM d
), c AS (
    SELECT w.lang, w.source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), total AS (
    SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
), p AS (
    SELECT lang, g.source, term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total.n, 0) + 5 * v.v) AS p,
           1 + (1000000000::HUGEINT * (kept.n + 5)) // (v.n + 5 * v.v) AS q
    FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)
), far AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
