"""URL rules, quality rules, importance resampling, personal data, WARC."""

import base64
import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from newsloom.llm import importance, pii, quality_rules, url_rules, warc
from newsloom.llm.common import kth_largest
from newsloom.session import scratch_path

URLS = [
    (1, "http://www.Example.com/en/1?x=1#y"), (2, "https://example.com/en/2"), (3, "https://a.example.com/fr"),
    (4, "http://x.net/es/1"), (5, "http://x.net/de/1"), (6, None), (7, "no scheme"), (8, "http://com"), (9, "http://com/"),
    (10, "http://notexample.com/en/1"), (11, "http://net#/es/"), (12, "http://net/fr/?a"), (13, ""), (14, "a://b://c/d"),
    (None, "http://x.org/"), (5, "http://x.net/de/1"),
]


def rule_by_force(url):
    match = re.search("://", url or "")
    if not match:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url[match.end() :], re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in url_rules.GIVEN_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_given_and_mined_rules(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'own' AS verdict", "1 AS host")
    mined = [url_rules.MinedRule(("host:net", "path:de"), 1.0, 0.1), url_rules.MinedRule(("scheme:a",), 1.0, 0.1)]
    rows = url_rules.judge_urls(pages, mined).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = rule_by_force(r.url)
        by_mined = "block" if (r.url or "").startswith(("http://x.net/de", "a://")) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or by_mined)
    assert url_rules.judge_urls(pages.limit(0), mined).count() == 0


def test_rules_are_mined(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.org/{'de' if i % 2 else 'fr'}/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_rules(pages, labels)
    # bad host and path fr together, never one of them alone
    assert rules and all({"host:bad", "path:fr"} <= set(r.tokens) for r in rules)
    verdicts = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert all((v == "block") == (i % 6 == 0) for i, v in verdicts.items())
    assert url_rules.mine_rules(pages.limit(0), labels) == []


def test_rules_of_every_bad_host_are_kept(spark):
    """Frequent bad hosts with very many redundant combinations leave the rules of a less frequent one."""
    rows = [f"http://bad{h}.a{h}-b{h}-c{h}.d{h}/e{h}/f{h}/g{h}?h{h}=1&i{h}=2" for h in range(4) for _ in range(30)]
    rows += ["http://rare.org/x"] * 12 + [f"http://good{i % 50}.org/x" for i in range(300)]
    pages = spark.createDataFrame([(i, url) for i, url in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int("good" in url), 0) for i, url in enumerate(rows)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_rules(pages, labels)
    assert ("host:rare",) in {r.tokens for r in rules} and {len(r.tokens) for r in rules} == {1}
    verdicts = {r.url: r.verdict for r in url_rules.judge_urls(pages, rules).collect()}
    assert all((v == "allow") == ("good" in url) for url, v in verdicts.items())


def test_rules_of_urls_that_share_many_tokens(spark):
    """Forty query keys of one bad host, most of them in all of its URLs, are no combinations."""
    keys = [f"k{i}=1" for i in range(40)]
    rows = ["http://bad.org/x?" + "&".join(keys[: 40 - i % 3]) for i in range(30)]
    rows += ["http://half.org/y?a=1&b=2&c=3&d=4"] * 40 + ["http://half.org/z?a=1&b=2&c=3&d=4"] * 20 + [f"http://good{i % 50}.org/x" for i in range(200)]
    bad = ["bad.org" in url or "half.org/y" in url or (i % 2 == 0 and "half" in url) for i, url in enumerate(rows)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_rules(pages, labels)
    # every key stands for itself, as does the host
    singles = {t for r in rules if len(r.tokens) == 1 for t in r.groups[0]}
    assert {f"key:k{i}" for i in range(40)} | {"host:bad", "path:y", "host:half", "key:a"} <= singles
    judged = url_rules.judge_urls(spark.createDataFrame([(1, "http://new.org/x?k39=1"), (2, "http://new.org/x?k40=1")], "page_id long, url string"), rules)
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "allow"}


def test_rules_are_the_least_ones(spark):
    """Against all parts by brute force; five tokens that only together are bad form a rule."""
    rnd = np.random.default_rng(2)
    baskets = [set("abcdefg"[i] for i in range(7) if rnd.random() < 0.75) for _ in range(300)]
    baskets = [b | ({url_rules.BLOCK} if set("abcde") <= b or ("f" in b and rnd.random() < 0.3) else set()) for b in baskets]
    counts = {}
    for b in baskets:
        for k in range(1, len(b) + 1):
            for c in itertools.combinations(sorted(b), k):
                counts[c] = counts.get(c, 0) + 1
    sets = spark.createDataFrame([(list(c), k) for c, k in counts.items() if k >= 10], "items array<string>, freq long")
    got = {tuple(r.tokens): r.confidence for r in url_rules._least_rules(sets, 300, 0.6, 1.5)}
    share = counts[(url_rules.BLOCK,)] / 300
    sure = {}
    for c in counts:
        both = counts.get(tuple(sorted((*c, url_rules.BLOCK))), 0)
        if url_rules.BLOCK not in c and both >= 10 and both / counts[c] >= 0.6 and both / counts[c] / share >= 1.5:
            sure[c] = both / counts[c]
    want = {c: p for c, p in sure.items() if not any(set(o) < set(c) and q >= p for o, q in sure.items())}
    assert got == want and ("a", "b", "c", "d", "e") in got


def statistics_by_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def test_statistics(small):
    short = small.where("doc_id IS NULL OR doc_id NOT IN (12, 13)")
    rows = quality_rules.judge(short, [], keep=["doc_id", "text"]).collect()
    assert len(rows) == short.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == statistics_by_force(r.text)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and r.kept == (not r.base_failed)
    assert quality_rules.judge(short.limit(0), []).count() == 0


def test_rules_are_learned_and_hold_on_other_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    assert rules
    other = quality_rules.judge(docs, rules, keep=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").toPandas()
    good = other[other.quality == 1]
    bad = other[other.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.1
    assert quality_rules.fit_rules(docs, labels.limit(0)) == []


def test_decision_list_order(spark):
    x = {f: np.array([0.0, 1.0, 2.0, 3.0] * 10) for f in quality_rules.FEATURES}
    bad = np.array([False, False, True, True] * 10)
    rules = quality_rules.learn_rules(x, bad, np.arange(40) % 3 == 0)
    assert len(rules) == 1 and rules[0][0].threshold == 1.5 and rules[0][0].above


def test_importance(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = importance.importance_sample(docs, labels).join(labels, "doc_id", "left").toPandas()
    kept = int(rows.kept.sum())
    assert set(rows.nlargest(kept, "gumbel_key").doc_id) == set(rows[rows.kept].doc_id)
    assert rows[rows.quality == 1].kept.mean() > 0.9 > 0.5 > rows[rows.quality == 0].kept.mean()
    # the same documents alone, in another order, have the same noise
    again = importance.importance_sample(docs.orderBy("text"), labels, seed=7).toPandas()
    assert set(again[again.kept].doc_id) != set()


def test_importance_edges(small, spark):
    labels = spark.createDataFrame([(1, 1, 0), (16, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = importance.importance_sample(small, labels, fraction=0.5).collect()
    assert len(rows) == small.count() and len({r.kept for r in rows if r.doc_id == 4}) == 1
    assert all(r.log_ratio == 0 for r in rows if r.doc_id in (7, 8, 9))
    assert importance.importance_sample(small.limit(0), labels).count() == 0
    assert importance.importance_sample(small, labels.limit(0), fraction=1.0).where("NOT kept").count() == 0


def test_importance_values_by_force(unique, spark):
    """Words and word pairs counted one by one; only the bucket of a word or pair is taken from the module."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 0), (10, 1, 1), (15, 1, None)], "doc_id long, quality int, toxic int")
    features = 997
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    known = {}

    def buckets(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for part in [*words, *(f"{a} {b}" for a, b in itertools.pairwise(words))]:
            if part not in known:
                known[part] = int(importance.feature_buckets(part.encode(), features)[-1])
            yield known[part]

    target, raw = [0] * features, [0] * features
    for i, text in texts.items():
        for b in buckets(text):
            raw[b] += 1
            target[b] += i in (1, 4, 15)
    sums = [sum(target) + features, sum(raw) + features]
    want = {
        i: sum(math.log((target[b] + 1) / sums[0]) - math.log((raw[b] + 1) / sums[1]) for b in buckets(text)) for i, text in texts.items()
    }
    rows = importance.importance_sample(unique.selectExpr("*", "1 AS log_ratio"), labels, fraction=0.4, features=features).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.log_ratio == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9)
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    assert all(r.kept == (r.gumbel_key >= keys[round(0.4 * len(rows)) - 1]) for r in rows)
    noise = [r.gumbel_key - r.log_ratio for r in rows]
    assert len(set(noise)) == len(rows) and all(math.isfinite(x) for x in noise)


@pytest.mark.parametrize("k", [1, 2, 37, 100, 150])
def test_kth_largest(spark, k):
    values = [float(i % 50) ** 3 for i in range(100)]
    got = kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, bins=4)
    assert got == sorted(values, reverse=True)[min(k, 100) - 1]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans_by_force(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) < 256 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, small):
    rnd = np.random.default_rng(4)
    parts = ["a", "@", "b.c", ".", "-", "+", " ", "(1)", "12", "4111111111111111", "+1 (234) 567-8901", "é", "😀", "\n", "1.2.3.4", "x@y.zz", "_"]
    texts = [(1000 + i, "".join(rnd.choice(parts, rnd.integers(0, 12)))) for i in range(400)]
    more = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    docs = small.select("doc_id", "text").union(more).selectExpr("*", "'x' AS spans")
    rows = pii.personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [tuple(s) for s in r.base] == spans_by_force(r.text)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_contexts_find_unknown_identifiers(spark):
    rows = [(i, f"hello token{i % 7}x account: {4111111111111111 if i < 8 else f'AC-{i}77-Q'} bye") for i in range(12)]
    rows += [(100 + i, f"dial: +1 (234) 567-89{i:02d} now") for i in range(9)] + [(120, "dial: 555-0199, please"), (121, "room 555-0199 there")]
    seeds = [(200 + i, f"account: {n} x") for i, n in enumerate(("4012888888881881", "5555555555554444", "378282246310005", "6011111111111117", "4222222222222"))]
    docs = spark.createDataFrame(rows + seeds, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, r.text[s.start : s.stop]) for s in r.spans] for r in pii.personal_data(docs, min_score=0.6, min_entities=5).collect()}
    assert got[120] == [("phone", "555-0199")] and got[121] == []
    assert got[9] == [("card", "AC-977-Q")]


def test_identifiers_in_parts_and_in_lists(spark):
    rows = [(i, f"dial: +1 (234) 567-89{i:02d} now") for i in range(40)]
    cards = ("4012888888881881", "5555555555554444", "378282246310005", "6011111111111117", "4222222222222", "4111111111111111")
    rows += [(100 + i, f"account: {cards[i % 6]}, {cards[(i + 1) % 6]} x") for i in range(40)]
    asked = {
        200: ("dial: (234) 567-8901", [("phone", "(234) 567-8901")]),
        201: ("account: 4111 1111 1111 1112 bye", [("card", "4111 1111 1111 1112")]),
        202: ("account: AC-1, AC-2 , AC-3\nAC-4 AC5", [("card", "AC-1"), ("card", "AC-2"), ("card", "AC-3"), ("card", "AC-4 AC5")]),
        203: ("account: 4111111111111111, AC-1 b", [("card", "4111111111111111"), ("card", "AC-1")]),
        204: ("account:" + " " * 80 + "AC-9", [("card", "AC-9")]),
        205: ("é😀 dial: (555) 12\t34 room2: 99 x", [("phone", "(555) 12\t34 room2")]),
        206: ("room 12 34, 56", []),
    }
    docs = spark.createDataFrame(rows + [(i, text) for i, (text, _) in asked.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for i, (_, spans) in asked.items():
        assert [(s.kind, got[i].text[s.start : s.stop]) for s in got[i].spans] == spans
    found = pii.found_entities(docs).collect()
    contexts = {r.doc_id: [s.context for s in r._card] for r in found}
    assert all(contexts[100 + i] == ["account:", "account:"] for i in range(40))
    assert {r.doc_id: [t.context for t in r._tokens] for r in found}[205] == ["dial:", "room2:"]


def test_contexts_of_very_many_matches(spark):
    text = "account: " + " ".join(f"a{i}@b.cc, AC-{i}," for i in range(700))
    (row,) = pii.found_entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [s.value for s in row._email] == [f"a{i}@b.cc" for i in range(700)]
    assert [t.value for t in row._tokens] == [f"AC-{i}," for i in range(700)]
    assert {s.context for s in row._email + row._tokens} == {"account:"}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cc, card 4111 1111 1111 1111!"), (2, "none"), (3, None)], "doc_id long, text string")
    rows = pii.personal_data(docs).select("doc_id", pii.redacted(pii.F.col("text"), pii.F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in rows} == {1: "to <EMAIL>, card <CARD>!", 2: "none", 3: None}


@pytest.mark.parametrize(("min_bytes", "chunk"), [(0, 7), (0, 8), (0, 15), (20, 1 << 18)])
def test_archives(spark, min_bytes, chunk):
    marker = "x WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"
    rows = [(1, "http://a/", "<p>äö</p>"), (2, None, "<p>äö</p>"), (3, "u\r\nv", marker), (4, "w", None), (5, "w", ""), (6, "v", "line\n\r\n\n"), (7, "v", "y" * 500 + marker), (8, "q", marker), (None, "n", "no id"), (6, "v", "line\n\r\n\n")]
    # payloads, chunks and URLs that end like the version line or go on with one
    rows += [(9, "http://x/WARC/1.1", "ends in WARC/1.1"), (10, "WARC/1.1", "WARC/1.1\r"), (11, "a WARC/1.1", "WARC/1.1"), (12, "z", "WARC/1.1" * 9 + "\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS record_type").repartition(3)
    back = warc.round_trip(pages, min_bytes, chunk).collect()
    assert sorted(r.page_id or 0 for r in back) == sorted(r[0] or 0 for r in rows)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back}
    last = {}
    for page_id, _, html in rows:
        if page_id:
            last[html or ""] = max(page_id, last.get(html or "", 0))
    want = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisit = bool(page_id) and len(raw) >= min_bytes and page_id < last[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[page_id] = (len(raw), digest, "revisit" if revisit else "response", last[html or ""] if revisit else None)
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_are_bounded_and_whole(spark):
    text = "é" * 1000 + "WARC/1.1\r\n" + "z" * 1000
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([(1, "u", text)], "page_id long, url string, html string"), path, chunk_bytes=300)
    chunks = sorted(warc.read_chunks(spark, path).collect(), key=lambda r: r.chunk_no)
    assert b"".join(bytes(c.content) for c in chunks).decode() == text
    assert all(c.content.decode() for c in chunks) and max(len(c.content) for c in chunks) <= 300
    assert {c.record_type for c in chunks} == {"response", "continuation"}
