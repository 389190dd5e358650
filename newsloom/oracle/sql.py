"""The registered queries restated in DuckDB SQL, independent of the Spark code.

Every query is a chain of named parts; :func:`chain` adds the parts a query needs.
Patterns and word lists are the same fixed values the Spark side uses.
"""

from __future__ import annotations

import re

from newsloom.functions.text import LANGUAGE_PROFILES, STOP_WORDS

WORD = r"[\p{L}\p{N}_]+"
WORD_2 = r"[\p{L}\p{N}_]{2,}"
CAPITALISED = r"^[^\p{L}\p{N}_]*\p{Lu}"
AS_OF = "TIMESTAMP '2024-01-04 00:00:00'"
SPLIT_AS_OF = "TIMESTAMP '2024-01-03 12:00:00'"

KIND_SHARES = {
    "tfidf": "1 / (3 + 1e-12)",
    "title_ent": "1 / (2 + 1e-12) / (3 + 1e-12)",
    "text_ent": "1 / (2 + 1e-12) / (3 + 1e-12)",
    "vector": "1 / (3 + 1e-12)",
}


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def first_words(text: str, n: int) -> str:
    return f"array_to_string(string_split({text}, ' ')[1:{n}], ' ')"


def tokens(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '{WORD_2}')"


def search_words(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '{WORD}'), "
        f"lambda w: NOT list_contains({word_list(STOP_WORDS)}, w))"
    )


def sentence_words(text: str) -> str:
    return (
        f"list_transform(regexp_split_to_array({text}, '[.!?]+\\s+|\\n+'), "
        f"lambda s: list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> ''))"
    )


def lone_first_words(text: str) -> str:
    return (
        f"list_filter(list_transform({sentence_words(text)}, lambda ws: CASE "
        f"WHEN regexp_matches(coalesce(ws[1], ''), '{CAPITALISED}') "
        f"AND NOT regexp_matches(coalesce(ws[2], ''), '{CAPITALISED}') "
        f"THEN lower(regexp_replace(ws[1], '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) END), lambda w: w <> '')"
    )


def entities(text: str) -> str:
    """List of entity words."""
    kept = (
        f"list_transform({sentence_words(text)}, lambda ws: list_filter(ws, lambda w, i: regexp_matches(w, '{CAPITALISED}') "
        f"AND (i > 1 OR regexp_matches(coalesce(ws[2], ''), '{CAPITALISED}'))))"
    )
    cleaned = f"list_transform(flatten({kept}), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')))"
    return f"list_filter({cleaned}, lambda w: w <> '')"


def grams(word: str) -> str:
    return (
        f"flatten(list_transform([2, 3, 4], lambda n: list_transform("
        f"range(1, length({word}) - n + 2), lambda i: substring({word}, i, n))))"
    )


def fuzzy_tokens(text: str) -> str:
    return (
        f"list_filter(list_transform(string_split(trim({text}), ' '), "
        f"lambda t: trim(lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))), lambda t: t <> '')"
    )


def marked_words(words: str) -> str:
    """Cleaned words of one sentence with their marks."""
    return (
        f"list_filter(list_transform({words}, lambda w, i: {{'word': lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')), "
        f"'capital': regexp_matches(w, '{CAPITALISED}'), 'entity': regexp_matches(w, '{CAPITALISED}') "
        f"AND (i > 1 OR regexp_matches(coalesce({words}[2], ''), '{CAPITALISED}'))}}), lambda m: m.word <> '')"
    )


def url_domain(url: str) -> str:
    host = f"replace(replace(replace(lower({url}), 'https://', ''), 'http://', ''), 'www.', '')"
    return f"split_part(split_part(split_part({host}, '/', 1), '?', 1), '#', 1)"


def normalize_url(url: str) -> str:
    cut = f"split_part(split_part(lower({url}), '?', 1), '#', 1)"
    cut = f"regexp_replace({cut}, '/index\\.html$', '')"
    cut = f"regexp_replace({cut}, '^(https?://)www\\.', '\\1')"
    return f"nullif(regexp_replace(replace({cut}, 'http://', 'https://'), '/$', ''), '')"


def with_scheme(url: str) -> str:
    return f"CASE WHEN {url} LIKE 'http://%' OR {url} LIKE 'https://%' THEN {url} ELSE 'https://' || {url} END"


def article_id(url: str) -> str:
    return f"translate(replace(replace(lower({url}), 'https://', ''), 'http://', ''), '/.', '__')"


def link_domain(url: str) -> str:
    host = f"replace(replace(replace(trim(lower({url})), 'https://', ''), 'http://', ''), 'www.', '')"
    return f"split_part(split_part({host}, '/', 1), '?', 1)"


def link_url(url: str) -> str:
    bare = f"replace(replace({url}, 'https://', ''), 'http://', '')"
    return f"nullif(regexp_replace(split_part({bare}, '?', 1), '/$', ''), '')"


def decay(ts: str, target: str, offset: int) -> str:
    hours = f"(epoch_us({target}) - epoch_us({ts})) / 3.6e9"
    return f"CASE WHEN {ts} IS NULL THEN 0.0 ELSE exp(ln(0.5) / 12.0 * greatest(0.0, abs({hours}) - {offset})) END"


def factor(boost: str, const: float, weight: float, low: float, high: float) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {const}::DOUBLE + {weight}::DOUBLE * ({boost})))"


def unescape(text: str) -> str:
    for entity, letter in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        text = f"replace({text}, '{entity}', '{letter}')"
    return text


def plain_text(text: str) -> str:
    block = "(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section|blockquote)(\\s[^>]*)?/?>"
    text = f"regexp_replace(regexp_replace({text}, '{block}', chr(10), 'g'), '<[^>]*>', '', 'g')"
    text = f"regexp_replace({unescape(text)}, '[ \\t\\r]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' *\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"


def meta(name: str) -> str:
    key = f'(?:name|property)="{name}"'
    after = f"regexp_extract(html, '(?is)<meta\\s[^>]*{key}[^>]*content=\"([^\"]*)\"', 1)"
    before = f"regexp_extract(html, '(?is)<meta\\s[^>]*content=\"([^\"]*)\"[^>]*{key}', 1)"
    return unescape(f"coalesce(nullif({after}, ''), nullif({before}, ''), '')")


def language(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '{WORD}')"
    hits = ", ".join(
        f"{{'hits': len(list_filter({words}, lambda w: list_contains({word_list(profile)}, w))), "
        f"'place': {-place}, 'code': '{code}'}}"
        for place, (code, profile) in enumerate(sorted(LANGUAGE_PROFILES.items()))
    )
    best = f"list_max([{hits}])"
    return f"CASE WHEN ({best}).hits > 0 THEN ({best}).code ELSE 'und' END"


# ------------------------------------------------------------------ named parts

_TITLE, _BEGINNING = first_words("d.text", 12), first_words("d.text", 100)

PARTS: dict[str, str] = {
    "articles": f"""
        SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS id, d.doc_id AS doc_id,
               {_TITLE} AS article_title, d.text AS article_text, {_BEGINNING} AS article_text_beginning,
               'author' || CAST(d.doc_id % 37 AS VARCHAR) AS author,
               'https://www.' || d.source || '.example.com/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) AS article_url,
               'https://' || d.source || '.example.com/' || d.lang || '/' || CAST(d.doc_id AS VARCHAR) AS normalized_url,
               d.source || '.example.com' AS source, d.source AS source_name, d.lang AS lang,
               e.ts AS ts, CAST(e.ts AS DATE) AS day, CAST(v.embedding AS DOUBLE[]) AS vec, e.value AS value
        FROM documents d JOIN events e ON e.event_id = d.doc_id
        LEFT JOIN embeddings v ON v.vec_id = d.doc_id""",
    "scored": """
        SELECT *, CASE WHEN value >= 5 THEN value / (value + 100) END AS c15,
               list_filter([CASE WHEN value > 30 THEN 'centroid_k50' END, CASE WHEN value > 60 THEN 'centroid_k20' END,
                            CASE WHEN value > 90 THEN 'centroid_k10' END, CASE WHEN value > 120 THEN 'centroid_k5' END],
                           lambda t: t IS NOT NULL) AS tags
        FROM articles""",
    "parsed": """
        SELECT 'http://www.' || d.source || '.example.com/' || d.lang || '/' || CAST(d.n_chars AS VARCHAR) AS url,
               d.lang AS lang, e.ts AS ts, d.doc_id AS order_key
        FROM documents d JOIN events e ON e.event_id = d.doc_id""",
    "built": f"SELECT {normalize_url('url')} AS normalized_url, lang, ts, order_key FROM parsed",
    "links": """
        SELECT strftime(e.ts, '%Y%m%d%H') || '0000.LINKS.TXT.gz' AS file_name, p.url AS url
        FROM pages p JOIN events e ON e.event_id = p.page_id""",
    "domains": f"""
        SELECT DISTINCT {link_domain("regexp_extract(url, '^(https?://[^/]+)', 1) || '/'")} AS domain_name
        FROM pages WHERE url LIKE '%.html'""",
    "listed": f"""
        SELECT file_name, {link_url('url')} AS url FROM links
        WHERE {link_domain('url')} IN (SELECT domain_name FROM domains)""",
    "cleaned": """
        SELECT page_id, url, html, regexp_replace(html,
               '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS clean
        FROM pages""",
    "bodies": """
        SELECT *, regexp_replace(CASE WHEN regexp_extract(clean, '(?is)<article[^>]*>(.*?)</article>', 1) <> ''
                    THEN regexp_extract(clean, '(?is)<article[^>]*>(.*?)</article>', 1)
                    ELSE regexp_extract(clean, '(?is)<body[^>]*>(.*)', 1) END,
                  '(?is)<h1[^>]*>.*?</h1>', '', 'g') AS body
        FROM cleaned""",
    "extracted": f"""
        SELECT page_id, url, {plain_text("regexp_extract(clean, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
               {plain_text('body')} AS text,
               lower(regexp_extract(html, '(?is)<html[^>]*\\slang="([a-zA-Z]{{2}})', 1)) AS declared,
               {meta('og:image')} AS top_image, {meta('author')} AS authors
        FROM bodies""",
    "idf": f"""
        SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*))) + 1 AS idf
        FROM (SELECT unnest(list_distinct({tokens('text')})) AS term FROM benchmark) GROUP BY term""",
    "kind_texts": f"""
        SELECT day, id, 'tfidf' AS kind, article_title || article_text_beginning AS text FROM articles
        UNION ALL SELECT day, id, 'title_ent', array_to_string({entities('article_title')}, ' ') FROM articles
        UNION ALL SELECT day, id, 'text_ent',
               array_to_string({entities(first_words('article_text', 300))}, ' ') FROM articles""",
    "gazetteer": f"""
        SELECT DISTINCT array_to_string(words[p:p + n - 1], ' ') AS phrase
        FROM (SELECT words, unnest(range(1, len(words) + 1)) AS p
              FROM (SELECT list_transform(ms, lambda m: m.word) AS words
                    FROM (SELECT {marked_words('s')} AS ms FROM (SELECT unnest({sentence_words('text')}) AS s FROM benchmark)))),
             (SELECT unnest([1, 2, 3]) AS n)
        WHERE p + n - 1 <= len(words)""",
    "entity_sentences": f"""
        SELECT id, kind, s, {marked_words('sentence')} AS ms
        FROM (SELECT id, kind, unnest(range(1, len(sentences) + 1)) AS s, unnest(sentences) AS sentence
              FROM (SELECT id, 'title_ent' AS kind, {sentence_words('article_title')} AS sentences FROM articles
                    UNION ALL
                    SELECT id, 'text_ent', {sentence_words(first_words('article_text', 300))} FROM articles))""",
    "entity_rows": """
        SELECT id, kind, s, unnest(range(1, len(ms) + 1)) AS p, unnest(ms) AS m, list_transform(ms, lambda m: m.word) AS words
        FROM entity_sentences""",
    "phrase_hits": """
        SELECT id, kind, s, p, max(n) AS n FROM entity_rows, (SELECT unnest([1, 2, 3]) AS n)
        WHERE m.capital AND p + n - 1 <= len(words) AND array_to_string(words[p:p + n - 1], ' ') IN (SELECT phrase FROM gazetteer)
        GROUP BY id, kind, s, p""",
    "phrase_next": """
        SELECT a.id AS id, a.kind AS kind, a.s AS s, a.p AS p, a.n AS n, min(b.p) AS following,
               a.p = min(a.p) OVER (PARTITION BY a.id, a.kind, a.s) AS leads
        FROM phrase_hits a LEFT JOIN phrase_hits b ON b.id = a.id AND b.kind = a.kind AND b.s = a.s AND b.p >= a.p + a.n
        GROUP BY a.id, a.kind, a.s, a.p, a.n""",
    "phrase_taken": """
        WITH RECURSIVE walk AS (
            SELECT id, kind, s, p, n, following FROM phrase_next WHERE leads
            UNION ALL
            SELECT x.id, x.kind, x.s, x.p, x.n, x.following
            FROM walk w JOIN phrase_next x ON x.id = w.id AND x.kind = w.kind AND x.s = w.s AND x.p = w.following)
        SELECT id, kind, s, p, n FROM walk""",
    "entity_words": """
        SELECT r.id AS id, r.kind AS kind, string_agg(r.m.word, ' ' ORDER BY r.s, r.p) AS words
        FROM entity_rows r LEFT JOIN phrase_taken t
             ON t.id = r.id AND t.kind = r.kind AND t.s = r.s AND r.p BETWEEN t.p AND t.p + t.n - 1
        WHERE r.m.entity OR t.p IS NOT NULL GROUP BY r.id, r.kind""",
    "tf": f"""
        SELECT day, id, kind, term, count(*) AS tf
        FROM (SELECT day, id, kind, unnest({tokens('text')}) AS term FROM kind_texts) GROUP BY ALL""",
    "weights": """
        SELECT day, id, kind, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id, kind)) AS w
        FROM tf JOIN idf USING (term)""",
    "sizes": "SELECT day, count(*) AS n, count(DISTINCT source) AS n_sources FROM articles GROUP BY day",
    "gated": "SELECT * FROM sizes WHERE n > 10 AND n_sources > 1",
    "raw_pairs": """
        SELECT * FROM (
            SELECT a.day AS day, a.kind AS kind, a.id AS id_a, b.id AS id_b, round(sum(a.w * b.w), 9) AS v
            FROM weights a JOIN weights b ON a.day = b.day AND a.kind = b.kind AND a.term = b.term AND a.id < b.id
            JOIN articles x ON x.id = a.id JOIN articles y ON y.id = b.id AND x.source <> y.source
            GROUP BY ALL
            UNION ALL
            SELECT a.day, 'vector', a.id, b.id, round(list_dot_product(a.vec, b.vec), 9)
            FROM articles a JOIN articles b ON a.day = b.day AND a.id < b.id AND a.source <> b.source
            WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL)
        WHERE v <> 0""",
    "cells": """
        SELECT day, kind, v FROM raw_pairs UNION ALL SELECT day, kind, v FROM raw_pairs
        UNION ALL
        SELECT s.day, k.kind, 0.0 FROM sizes s
        CROSS JOIN (SELECT unnest(['tfidf', 'title_ent', 'text_ent', 'vector']) AS kind) k
        LEFT JOIN (SELECT day, kind, count(*) AS p FROM raw_pairs GROUP BY ALL) c ON c.day = s.day AND c.kind = k.kind,
        unnest(range(s.n * s.n - 2 * coalesce(c.p, 0)))""",
    "cuts": "SELECT day, kind, quantile_cont(v, 0.9) AS cut FROM cells GROUP BY ALL",
    "kept": """
        SELECT p.day AS day, p.kind AS kind, id_a, id_b, least(v, 1.0) AS v
        FROM raw_pairs p JOIN cuts c ON c.day = p.day AND c.kind = p.kind
        WHERE v >= round(cut, 12) AND v > 0""",
    "combined": "SELECT day, id_a, id_b, round(sum(v * CASE kind "
    + " ".join(f"WHEN '{k}' THEN {s}" for k, s in KIND_SHARES.items())
    + " END), 9) AS sim FROM kept GROUP BY ALL",
    "near_pairs": """
        SELECT a.kind AS kind, a.id AS id_a, b.id AS id_b, round(sum(a.w * b.w), 9) AS v
        FROM weights a JOIN weights b ON a.kind = b.kind AND a.term = b.term AND a.id < b.id
        JOIN articles x ON x.id = a.id JOIN articles y ON y.id = b.id AND x.source <> y.source
             AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 1.5 * 86400e6
        GROUP BY ALL
        UNION ALL
        SELECT 'vector', a.id, b.id, round(list_dot_product(a.vec, b.vec), 9)
        FROM articles a JOIN articles b ON a.id < b.id AND a.source <> b.source AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1.5 * 86400e6
        WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL""",
    "windows": """
        SELECT d.day AS day, a.id AS id
        FROM (SELECT DISTINCT day FROM articles) d JOIN articles a ON a.day BETWEEN d.day - 1 AND d.day + 1""",
    "window_pairs": """
        SELECT x.day AS day, p.kind AS kind, p.id_a AS id_a, p.id_b AS id_b, p.v AS v
        FROM near_pairs p JOIN windows x ON x.id = p.id_a JOIN windows y ON y.id = p.id_b AND y.day = x.day
        WHERE p.v <> 0""",
    "window_cells": """
        SELECT day, kind, v FROM window_pairs UNION ALL SELECT day, kind, v FROM window_pairs
        UNION ALL
        SELECT s.day, k.kind, 0.0 FROM (SELECT day, count(*) AS n FROM windows GROUP BY day) s
        CROSS JOIN (SELECT unnest(['tfidf', 'title_ent', 'text_ent', 'vector']) AS kind) k
        LEFT JOIN (SELECT day, kind, count(*) AS p FROM window_pairs GROUP BY ALL) c ON c.day = s.day AND c.kind = k.kind,
        unnest(range(s.n * s.n - 2 * coalesce(c.p, 0)))""",
    "window_cuts": "SELECT day, kind, quantile_cont(v, 0.9) AS cut FROM window_cells GROUP BY ALL",
    "window_kept": """
        SELECT p.day AS day, p.kind AS kind, id_a, id_b, least(v, 1.0) AS v
        FROM window_pairs p JOIN window_cuts c ON c.day = p.day AND c.kind = p.kind
        WHERE v >= round(cut, 12) AND v > 0""",
    "window_combined": "SELECT day, id_a, id_b, round(sum(v * CASE kind "
    + " ".join(f"WHEN '{k}' THEN {s}" for k, s in KIND_SHARES.items())
    + " END), 9) AS sim FROM window_kept GROUP BY ALL",
    "mirrored": """
        SELECT day, id_a AS id, id_b AS other_id, sim FROM combined
        UNION ALL SELECT day, id_b, id_a, sim FROM combined""",
    "best": """
        SELECT day, id, other_source, sim, other_id FROM (
            SELECT m.day AS day, m.id AS id, o.source AS other_source, m.sim AS sim, m.other_id AS other_id,
                   row_number() OVER (PARTITION BY m.id, o.source ORDER BY m.sim DESC, m.other_id) AS place
            FROM mirrored m JOIN articles o ON o.id = m.other_id JOIN gated g ON g.day = m.day WHERE m.sim > 0)
        WHERE place = 1""",
    "ranked_best": "SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC) AS place FROM best",
    "scores": "SELECT a.day AS day, a.id AS id, "
    + ", ".join(
        f"coalesce(sum(CASE WHEN place <= {k} THEN sim END), 0) / least({k}, g.n_sources - 1) AS centrality_score_{name}"
        for name, k in (("3", "3"), ("10", "10"), ("15", "15"), ("half", "ceil(g.n_sources / 2)"), ("all", "(g.n_sources - 1)"))
    )
    + """ FROM articles a JOIN gated g ON g.day = a.day LEFT JOIN ranked_best b ON b.id = a.id
        GROUP BY a.day, a.id, g.n_sources""",
    "similar_rows": """
        SELECT b.id AS id, row_number() OVER (PARTITION BY b.id ORDER BY b.sim DESC, b.other_id DESC) - 1 AS position,
               b.sim AS similarity, b.other_id AS other_id, o.article_title AS title, o.article_url AS url
        FROM best b JOIN articles o ON o.id = b.other_id""",
    "sims": """
        SELECT m.day AS day, m.id AS i, m.other_id AS j, m.sim AS s FROM mirrored m JOIN gated g ON g.day = m.day
        UNION ALL SELECT a.day, a.id, a.id, 1.0 FROM articles a JOIN gated g ON g.day = a.day""",
    "wsims": "SELECT s.day AS day, i, j, s, centrality_score_half AS w FROM sims s JOIN scores c ON c.id = s.j",
    "cov0": "SELECT day, id, 0.0::DOUBLE AS cov FROM scores",
    "queries": f"""
        SELECT 'q' || lpad(CAST(b.item_id AS VARCHAR), 8, '0') AS qid, substr(b.text, 1, 250) AS q,
               CASE WHEN length(b.text) > 250 THEN '2024-01-02' ELSE '' END AS min_date,
               CASE WHEN length(b.text) < 150 THEN '2024-01-02' ELSE '' END AS max_date,
               CAST(v.embedding AS DOUBLE[]) AS qvec
        FROM benchmark b LEFT JOIN embeddings v ON v.vec_id = b.item_id""",
    "asked": f"SELECT qid, unnest(list_distinct({search_words('q')})) AS term FROM queries",
    "asked_grams": f"SELECT DISTINCT qid, unnest({grams('term')}) AS term FROM asked",
    "words": "\n UNION ALL ".join(
        f"SELECT id, '{field}' AS field, {weight} AS weight, unnest({search_words(column)}) AS word FROM articles"
        for field, column, weight in (
            ("article_title", "article_title", 1.5),
            ("article_text_beginning", "article_text_beginning", 0.1),
            ("article_text", "article_text", 0.1),
            ("source_name", "source_name", 1.0),
            ("article_authors", "author", 1.0),
        )
    ),
    "word_tf": """
        SELECT id, field, weight, word AS term, count(*) AS tf FROM words
        WHERE field <> 'article_text' AND word IN (SELECT term FROM asked) GROUP BY ALL""",
    "gram_tf": f"""
        SELECT id, field, weight, term, count(*) AS tf
        FROM (SELECT id, field, weight, unnest({grams('word')}) AS term FROM words)
        WHERE term IN (SELECT term FROM asked_grams) GROUP BY ALL""",
    "word_parts": "",
    "gram_parts": "",
    "any_scores": """
        SELECT qid, id, sum(part) AS any_score, count(DISTINCT term) AS n_found
        FROM word_parts JOIN asked USING (term) GROUP BY qid, id""",
    "gram_scores": "SELECT qid, id, sum(part) AS ngram_score FROM gram_parts JOIN asked_grams USING (term) GROUP BY qid, id",
    "asked_sizes": "SELECT qid, count(*) AS n_terms FROM asked GROUP BY qid",
    "text_scores": """
        SELECT qid, id, coalesce(any_score, 0) AS any_score,
               CASE WHEN n_found = n_terms THEN any_score ELSE 0 END AS all_score, coalesce(ngram_score, 0) AS ngram_score
        FROM gram_scores FULL JOIN any_scores USING (qid, id) LEFT JOIN asked_sizes USING (qid)""",
    "word_scores": """
        SELECT qid, id, any_score, CASE WHEN n_found = n_terms THEN any_score ELSE 0 END AS all_score
        FROM any_scores JOIN asked_sizes USING (qid)""",
    "top_hits": "",
}

for _kind in ("word", "gram"):
    PARTS[f"{_kind}_parts"] = f"""
        SELECT id, term, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.25 / (tf + 0.25)) AS part
        FROM {_kind}_tf JOIN (SELECT field, term, count(*) AS df FROM {_kind}_tf GROUP BY ALL) USING (field, term),
             (SELECT count(*)::DOUBLE AS n FROM articles)
        GROUP BY id, term"""

_COSINE = "coalesce(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN list_cosine_similarity({a}, {b}) END, 0.0)"


def in_range(ts: str) -> str:
    return (
        f"(min_date = '' OR {ts} >= CAST(nullif(min_date, '') || ' 00:00:00' AS TIMESTAMP)) AND "
        f"(max_date = '' OR {ts} <= CAST(nullif(max_date, '') || ' 23:59:59' AS TIMESTAMP))"
    )


def top_hits(as_of: str) -> str:
    cosine = _COSINE.format(a="a.vec", b="q.qvec")
    return f"""
        SELECT * FROM (
            SELECT qid, id, ts, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (
                SELECT t.qid AS qid, t.id AS id, a.ts AS ts,
                       round((any_score + all_score + ngram_score + CASE WHEN len(a.tags) > 0 THEN 1.5 ELSE 0 END)
                         * {factor(decay('a.ts', as_of, 48), 2, 1, 0, 3)}
                         * {factor('coalesce(a.c15, 0)', 1, 2, 1, 10)}
                         * {factor(cosine, 3, 1, 0, 5)}, 9) AS score
                FROM text_scores t JOIN scored a ON a.id = t.id JOIN queries q ON q.qid = t.qid
                WHERE {in_range('a.ts')}))
        WHERE place <= 500"""


def one_byte_letters(c: str) -> str:
    """Accented letters as capitals (which cannot occur), so that one letter is one byte."""
    return f"translate({c}, 'àâçèéêëîïôùûüñóíáúöäßœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


def close_words(hits: str, title_only: bool) -> dict[str, str]:
    text = "a.article_title" if title_only else "a.article_title || a.article_text_beginning"
    return {
        "hit_tokens": f"""
            SELECT a.id AS id, list_transform(list_distinct({fuzzy_tokens(text)}), lambda t: {one_byte_letters('t')}) AS tokens
            FROM articles a WHERE a.id IN (SELECT id FROM {hits})""",
        "query_tokens": f"SELECT qid, unnest(list_distinct({fuzzy_tokens('q')})) AS query_token FROM queries",
        "token_best": f"""
            SELECT qid, id, query_token,
                   coalesce(list_max(list_transform(tokens, lambda t: jaro_winkler_similarity(letters, t))), 0) AS best
            FROM (SELECT h.qid AS qid, h.id AS id, query_token, {one_byte_letters('query_token')} AS letters, tokens
                  FROM {hits} h JOIN query_tokens t ON t.qid = h.qid JOIN hit_tokens a ON a.id = h.id)""",
        "hit_scores": """
            SELECT qid, id, max(best) AS best_token, avg(best) AS mean_token, min(best) AS worst_token
            FROM token_best GROUP BY qid, id""",
    }


def chain(select: str, extra: dict[str, str] | None = None) -> str:
    """``select`` preceded by the parts it uses, directly or through other parts."""
    parts = {**PARTS, **(extra or {})}
    needed: dict[str, str] = {}

    def visit(sql: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b", sql):
            if name in parts and name not in needed:
                needed[name] = ""
                visit(parts[name])
                needed.pop(name)
                needed[name] = parts[name]

    visit(select)
    if not needed:
        return select
    listed = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in needed.items())
    return f"WITH {listed}\n{select}"


# class and number of links of every article; classes spread from the articles without a smaller partner
LINKED = """SELECT CAST(a.day AS VARCHAR) AS day, a.id AS id, coalesce(c.class_id, a.id) AS class_id, coalesce(n.n_links, 0) AS n_links
    FROM {articles} a
    LEFT JOIN classes c ON c.day = a.day AND c.id = a.id
    LEFT JOIN link_counts n ON n.day = a.day AND n.id = a.id
    WHERE a.day IS NOT NULL"""


def linked_parts(pairs: str) -> dict[str, str]:
    return {
        "links": f"SELECT day, id_a AS a, id_b AS b FROM {pairs} UNION ALL SELECT day, id_b, id_a FROM {pairs}",
        "link_counts": "SELECT day, a AS id, count(*) AS n_links FROM links GROUP BY ALL",
        "reached": """
            WITH RECURSIVE spread AS (
                SELECT day, a AS id, a AS root FROM links GROUP BY day, a HAVING min(b) > a
                UNION SELECT l.day, l.b, s.root FROM spread s JOIN links l ON l.day = s.day AND l.a = s.id)
            SELECT * FROM spread""",
        "classes": "SELECT day, id, min(root) AS class_id FROM reached GROUP BY ALL",
    }


def r6(c: str, name: str | None = None) -> str:
    return f"round({c} + 2e-10, 6) AS {name or c}"


def greedy_parts(rounds: int = 50) -> dict[str, str]:
    """Greedy rounds written out: gains, winner and coverage of each."""
    parts = {}
    for k in range(1, rounds + 1):
        parts[f"gain{k}"] = f"""
            SELECT s.day AS day, s.i AS i, round(sum(s.w * greatest(0, s.s - c.cov)), 9) AS gain
            FROM wsims s JOIN cov{k - 1} c ON c.id = s.j GROUP BY s.day, s.i"""
        parts[f"win{k}"] = f"""
            SELECT day, i FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY gain DESC, i) AS place FROM gain{k})
            WHERE place = 1 AND gain > 0"""
        parts[f"cov{k}"] = f"""
            SELECT c.day AS day, c.id AS id, greatest(c.cov, coalesce(s.s, 0)) AS cov
            FROM cov{k - 1} c LEFT JOIN win{k} w ON w.day = c.day LEFT JOIN sims s ON s.i = w.i AND s.j = c.id"""
    union = " UNION ALL ".join(f"SELECT day, i AS id, {k} AS round FROM win{k}" for k in range(1, rounds + 1))
    parts["chosen"] = union
    tags = ", ".join(f"CASE WHEN round <= {k} AND n > {5 * k} THEN 'centroid_k{k}' END" for k in (5, 10, 20, 50))
    parts["tagged"] = f"""
        SELECT day, id, tags FROM (
            SELECT c.day AS day, c.id AS id, concat_ws(',', {tags}) AS tags FROM chosen c JOIN sizes z ON z.day = c.day)
        WHERE tags <> ''"""
    return parts


CENTRALITY = ", ".join(r6(f"centrality_score_{k}") for k in ("3", "10", "15", "half", "all"))

ORACLES: dict[str, str] = {
    "url_normalize": f"SELECT page_id, {normalize_url(with_scheme('url'))} AS normalized_url FROM pages",
    "url_domain": f"SELECT page_id, {url_domain('url')} AS domain FROM pages",
    "article_id": f"SELECT page_id, {article_id(normalize_url('url'))} AS article_id FROM pages",
    "tokens": f"SELECT id, array_to_string({tokens('article_text')}, ' ') AS tokens FROM articles",
    "entity_tokens": f"SELECT id, array_to_string({entities('article_text')}, ' ') AS entities FROM articles",
    "entity_gazetteer": f"""
        SELECT a.id AS id, trim(array_to_string({entities('a.article_text')}, ' ') || ' ' || coalesce(k.known, '')) AS entities
        FROM articles a LEFT JOIN (
            SELECT id, string_agg(word, ' ' ORDER BY word) AS known
            FROM (SELECT id, unnest({lone_first_words('article_text')}) AS word FROM articles)
            WHERE word IN (SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) FROM benchmark)
            GROUP BY id) k ON k.id = a.id""",
    "entity_phrases": """
        SELECT a.id AS id, coalesce(t.words, '') AS title_ent, coalesce(x.words, '') AS text_ent FROM articles a
        LEFT JOIN entity_words t ON t.id = a.id AND t.kind = 'title_ent'
        LEFT JOIN entity_words x ON x.id = a.id AND x.kind = 'text_ent'""",
    "char_ngrams": f"""SELECT word, array_to_string({grams('word')}, ' ') AS grams
        FROM (SELECT DISTINCT unnest({search_words('article_text')}) AS word FROM articles)""",
    "lang_detect": f"""SELECT id, {language("article_title || '. ' || article_text")} AS language FROM articles""",
    "decay_boost": f"""SELECT id, {r6(decay('ts', AS_OF, 24), 'boost')},
        {r6(factor(decay('ts', AS_OF, 24), 0, 1, 0, 2), 'factor')} FROM articles""",
    "hour_grid": """
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(ts, '%Y%m%d%H') || '0000.LINKS.TXT.gz' AS file_name
        FROM (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)) + INTERVAL 23 HOUR,
                                            INTERVAL 6 HOUR)) AS ts FROM events)""",
    "link_scan": "SELECT DISTINCT file_name, url FROM links",
    "link_filter": f"SELECT DISTINCT url, {link_domain('url')} AS domain_name FROM listed WHERE url IS NOT NULL",
    "new_urls_per_file": """
        SELECT f.file_name AS file_name, count(s.url) AS n_new FROM (SELECT DISTINCT file_name FROM listed) f
        LEFT JOIN (SELECT url, min(file_name) AS file_name FROM listed GROUP BY url) s ON s.file_name = f.file_name
        GROUP BY f.file_name""",
    "historical_urls": f"""
        SELECT DISTINCT url, {link_domain('url')} AS domain_name FROM listed
        WHERE url IS NOT NULL AND substr(file_name, 9, 2) IN ('00', '12')""",
    "url_list_parts": """
        SELECT CAST(i * 8 // n AS INT) AS part, count(*) AS n, count(*) AS n_urls
        FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(DISTINCT url) AS n FROM listed WHERE url IS NOT NULL))
        GROUP BY part""",
    "source_tag": "SELECT id, upper(source_name) AS source_name FROM articles",
    "page_links": f"""
        SELECT DISTINCT url, link FROM (
            SELECT url, CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%' THEN href
                             WHEN href LIKE '//%' THEN 'https:' || href
                             WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS link
            FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages))
        WHERE {url_domain('link')} = {url_domain('url')}""",
    "html_extract": f"""
        SELECT page_id, title, text, coalesce(nullif(declared, ''), {language("title || '. ' || text")}) AS language,
               top_image, authors FROM extracted""",
    "build_articles": f"""
        SELECT {article_id(normalize_url('url'))} AS id, title AS article_title,
               {first_words('text', 100)} AS article_text_beginning, authors AS article_authors,
               {normalize_url('url')} AS normalized_url, {url_domain('url')} AS normalized_domain,
               coalesce(nullif(declared, ''), {language("title || '. ' || text")}) AS language_code,
               '2024-01-04 00:00:00' AS first_indexed_date, url AS article_url
        FROM extracted""",
    "dedup_new": """
        SELECT normalized_url, min(order_key) AS order_key FROM built
        WHERE CAST(ts AS DATE) <> DATE '2024-01-01' AND normalized_url NOT IN
              (SELECT normalized_url FROM built WHERE CAST(ts AS DATE) = DATE '2024-01-01')
        GROUP BY normalized_url""",
    "lang_filter": """
        SELECT normalized_url, min(lang) AS language_code, min(order_key) AS order_key FROM built
        WHERE lang IN ('en', 'fr') GROUP BY normalized_url""",
    "time_range_scan": """
        SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS publish_date FROM articles
        WHERE ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-02 18:00:00'""",
    "writeback": """
        SELECT id, round(CASE WHEN value > 100 THEN value / (value + 10) WHEN value > 50 THEN value / (value + 50)
                              ELSE c15 END + 2e-10, 6) AS centrality_score_15,
               CASE WHEN value > 30 AND value < 120 THEN 'centroid_k5' WHEN value > 50 THEN 'centroid_k50'
                    ELSE array_to_string(tags, ',') END AS tags
        FROM scored""",
    "idf_table": f"SELECT term, df, {r6('idf')} FROM idf",
    "tfidf_weights": f"SELECT id, kind, term, {r6('w', 'weight')} FROM weights",
    "similarity_threshold": f"SELECT CAST(c.day AS VARCHAR) AS day, kind, {r6('cut', 'threshold')} FROM cuts c JOIN gated g ON g.day = c.day",
    "tfidf_similarity": LINKED.format(articles="articles"),
    "embedding_similarity": f"SELECT CAST(day AS VARCHAR) AS day, id_a, id_b, {r6('v', 'sim')} FROM kept WHERE kind = 'vector'",
    "combined_similarity": LINKED.format(articles="articles"),
    "interval_similarity": LINKED.format(articles="windows"),
    "day_gate": "SELECT CAST(day AS VARCHAR) AS day, n, n_sources FROM gated",
    "source_best_match": f"SELECT CAST(day AS VARCHAR) AS day, id, other_source, {r6('sim')}, other_id FROM best",
    "centrality": f"SELECT CAST(day AS VARCHAR) AS day, id, {CENTRALITY} FROM scores",
    "similar_articles": f"SELECT id, position, {r6('similarity')}, other_id, title, url FROM similar_rows",
    "similar_display": """
        SELECT id, coalesce(string_agg(CASE WHEN similarity > 0.2 THEN other_id END, ',' ORDER BY position), '') AS shown
        FROM similar_rows GROUP BY id""",
    "centroid_first": f"""
        SELECT CAST(g.day AS VARCHAR) AS day, g.i AS id, {r6('g.gain', 'gain')} FROM gain1 g
        JOIN win1 w ON w.day = g.day AND w.i = g.i""",
    "centroid_tags": "SELECT CAST(day AS VARCHAR) AS day, id, tags FROM tagged",
    "daily_analysis": f"""
        SELECT CAST(s.day AS VARCHAR) AS day, s.id AS id,
               trim(array_to_string({entities('a.article_title')}, ' ') || ' ' ||
                    array_to_string({entities(first_words('a.article_text', 300))}, ' ')) AS article_entities,
               coalesce(t.tags, '') AS tags, {CENTRALITY}, coalesce(m.similar_ids, '') AS similar_ids
        FROM scores s JOIN articles a ON a.id = s.id LEFT JOIN tagged t ON t.id = s.id
        LEFT JOIN (SELECT id, string_agg(other_id, ',' ORDER BY position) AS similar_ids FROM similar_rows GROUP BY id) m
        ON m.id = s.id""",
    "gazetteer_analysis": f"""
        SELECT CAST(s.day AS VARCHAR) AS day, s.id AS id,
               trim(coalesce(e.words, '') || ' ' || coalesce(x.words, '')) AS article_entities,
               coalesce(t.tags, '') AS tags, {CENTRALITY}, coalesce(m.similar_ids, '') AS similar_ids
        FROM scores s LEFT JOIN tagged t ON t.id = s.id
        LEFT JOIN entity_words e ON e.id = s.id AND e.kind = 'title_ent'
        LEFT JOIN entity_words x ON x.id = s.id AND x.kind = 'text_ent'
        LEFT JOIN (SELECT id, string_agg(other_id, ',' ORDER BY position) AS similar_ids FROM similar_rows GROUP BY id) m
        ON m.id = s.id""",
    "home_feed": f"""
        SELECT id, {r6('score')}, array_to_string(tags, ',') AS tags FROM (
            SELECT id, tags, round((CASE WHEN list_has_any(tags, ['centroid_k5', 'centroid_k10', 'centroid_k20']) THEN 2.0 ELSE 0 END
                + CASE WHEN list_has_any(tags, ['centroid_k5', 'centroid_k10']) THEN 2.0 ELSE 0 END
                + CASE WHEN list_has_any(tags, ['centroid_k5']) THEN 2.0 ELSE 0 END)
                * {factor(decay('ts', AS_OF, 24), 0, 1, 0, 2)} * {factor('coalesce(c15, 0)', 0.1, 1, 0, 10)}, 9) AS score
            FROM scored WHERE list_contains(tags, 'centroid_k50') ORDER BY score DESC, id LIMIT 100)""",
    "bm25_search": f"SELECT qid, id, {r6('any_score')}, {r6('all_score')} FROM word_scores",
    "ngram_search": f"SELECT qid, id, {r6('ngram_score')} FROM text_scores",
    "search_date_filter": f"""
        SELECT w.qid AS qid, w.id AS id FROM word_scores w JOIN articles a ON a.id = w.id JOIN queries q ON q.qid = w.qid
        WHERE {in_range('a.ts')}""",
    "embedding_search": f"""
        SELECT w.qid AS qid, w.id AS id, {r6(factor(_COSINE.format(a='a.vec', b='q.qvec'), 3, 1, 0, 5), 'factor')}
        FROM word_scores w JOIN articles a ON a.id = w.id JOIN queries q ON q.qid = w.qid""",
    "vector_topk": f"""
        SELECT qid, id, {r6('score')}, place AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS place FROM (
                SELECT q.qid AS qid, a.id AS id, round(list_cosine_similarity(a.vec, q.qvec), 9) AS score
                FROM articles a JOIN queries q ON a.vec IS NOT NULL AND q.qvec IS NOT NULL))
        WHERE place <= 10""",
    "vector_ann_recall": "SELECT count(*) AS n_queries, true AS enough FROM articles WHERE vec IS NOT NULL AND CAST(id AS BIGINT) % 50 = 0",
    "stream_ingest": "SELECT DISTINCT normalized_url, lang AS language_code FROM built WHERE lang = 'en'",
    "stream_rejected": """
        SELECT normalized_url, lang AS language_code,
               CASE WHEN order_key % 7 = 0 THEN 'incomplete' ELSE 'language' END AS reason
        FROM built WHERE order_key % 7 = 0 OR lang NOT IN ('en', 'fr')""",
    "stream_pages": f"""
        SELECT DISTINCT normalized_url, upper(domain) AS source_name, language_code FROM (
            SELECT {normalize_url('url')} AS normalized_url, {url_domain('url')} AS domain, title, text,
                   coalesce(nullif(declared, ''), {language("title || '. ' || text")}) AS language_code FROM extracted)
        WHERE language_code IN ('en', 'de') AND title IS NOT NULL AND text IS NOT NULL""",
    "stream_analysis": f"SELECT id, {CENTRALITY} FROM scores",
    "stream_day_counts": """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""",
}

_SEARCH = {"top_hits": top_hits(AS_OF)}
_SPLIT = {"top_hits": top_hits(SPLIT_AS_OF)}
_LENIENT, _STRICT = "best_token > 0.9", "worst_token > 0.9"


def _filtered(condition: str) -> str:
    return f"SELECT h.qid AS qid, h.id AS id, h.ts AS ts, h.score AS score FROM top_hits h JOIN hit_scores s ON s.qid = h.qid AND s.id = h.id WHERE {condition}"


_MARKED = f"""
    SELECT *, coalesce(ts >= {SPLIT_AS_OF} - INTERVAL 1 DAY, false) AS recent,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS position FROM found"""
_PLACED = """
    SELECT *, count(CASE WHEN recent AND position <= 20 THEN 1 END) OVER (PARTITION BY qid) > 5 AS mixed,
           row_number() OVER (PARTITION BY qid, recent ORDER BY position) - 1 AS place FROM marked"""
_RANKED = """
    SELECT qid, id, ts, recent, row_number() OVER (PARTITION BY qid ORDER BY
        CASE WHEN NOT mixed THEN position WHEN recent THEN place ELSE place // 3 END,
        CASE WHEN NOT mixed OR recent THEN 0 ELSE 1 + place % 3 END) - 1 AS relevance_rank FROM placed"""
_ORDERING = {"marked": _MARKED, "placed": _PLACED, "ordered": _RANKED}

_EXTRA: dict[str, dict[str, str]] = {}


def _search(name: str, select: str, extra: dict[str, str]) -> None:
    ORACLES[name], _EXTRA[name] = select, extra


_search("search_very_strict", f"SELECT qid, id, {r6('score')} FROM found",
        {**_SEARCH, **close_words("top_hits", True), "found": _filtered(_STRICT)})
_search("search_strict", f"SELECT qid, id, {r6('score')} FROM found",
        {**_SEARCH, **close_words("top_hits", False), "found": _filtered(_STRICT)})
_search("search_lenient", f"SELECT qid, id, {r6('score')} FROM found",
        {**_SEARCH, **close_words("top_hits", False), "found": _filtered(_LENIENT)})
_search("search_very_lenient", f"SELECT qid, id, {r6('score')} FROM top_hits", _SEARCH)
_search("fuzzy_token_match", f"SELECT qid, id, {r6('best_token')}, {r6('mean_token')}, {r6('worst_token')} FROM hit_scores",
        close_words("word_scores", False))
_search("interleave", "SELECT qid, id, recent, relevance_rank FROM ordered",
        {**_SPLIT, "found": "SELECT qid, id, ts, score FROM top_hits", **_ORDERING})
_search("timeline", """
        SELECT qid, id, relevance_rank, row_number() OVER (PARTITION BY qid ORDER BY ts DESC, relevance_rank) - 1 AS timeline_position
        FROM ordered WHERE relevance_rank < 100""",
        {**_SPLIT, **close_words("top_hits", False), "found": _filtered(_LENIENT), **_ORDERING})
_search("search_summary", """
        SELECT q.qid AS qid, 'strict_matching' AS strictness, count(m.id) AS n_hits,
               count(CASE WHEN m.recent THEN 1 END) AS n_recent, count(CASE WHEN NOT m.recent THEN 1 END) AS n_older,
               count(CASE WHEN m.recent AND m.position <= 20 THEN 1 END) AS n_recent_in_top, count(m.id) < 5 AS advise_less_strict
        FROM queries q LEFT JOIN marked m ON m.qid = q.qid GROUP BY q.qid""",
        {**_SPLIT, **close_words("top_hits", False), "found": _filtered(_STRICT), **_ORDERING})

for _name in ("centroid_first", "centroid_tags", "daily_analysis"):
    _EXTRA[_name] = greedy_parts()
_EXTRA["gazetteer_analysis"] = greedy_parts() | {
    "kind_texts": """
        SELECT day, id, 'tfidf' AS kind, article_title || article_text_beginning AS text FROM articles
        UNION ALL SELECT a.day, a.id, e.kind, e.words FROM articles a JOIN entity_words e ON e.id = a.id"""
}

for _name, _pairs in (("tfidf_similarity", "tfidf_kept"), ("combined_similarity", "combined"), ("interval_similarity", "window_combined")):
    _EXTRA[_name] = linked_parts(_pairs) | {"tfidf_kept": "SELECT day, id_a, id_b FROM kept WHERE kind = 'tfidf'"}

ORACLES = {name: chain(select, _EXTRA.get(name)) for name, select in ORACLES.items()}
