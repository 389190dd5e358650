"""Exact dedup and Jaccard join against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import exact_dedup as E
from newsloom.llm import jaccard_join as J
from newsloom.llm.components import connected

BLANK = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def copies_by_force(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), i))
    out = {}
    for body, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest())
    return out


def links_by_force(rows, n, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = ({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i), links[i]) for i in ids}


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_copies(unique):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_duplicates(unique).collect()}
    assert got == copies_by_force(rows_of(unique))


def test_copies_keep_every_row(small):
    got = E.exact_duplicates(small).collect()
    assert len(got) == small.count()
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert [r.group_size for r in got if r.doc_id == 4] == [2, 2]


def test_weak_fingerprints_are_split(unique):
    """With a tiny modulus many texts collide; the chunk comparison must find and split them."""
    weak = (E.Polynomial(3, 5), E.Polynomial(2, 3))
    texts = unique.sparkSession.createDataFrame([(i, f"{i:03d}") for i in range(60)] + [(60, "007")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in E.exact_duplicates(texts, polynomials=weak, chunk_bytes=2).collect()}
    assert got == {i: i for i in range(60)} | {60: 7}


@given(st.binary(max_size=300), st.integers(1, 40))
def test_fingerprints_compose(data, size):
    assert E.fingerprint(data, chunk_bytes=size) == E.fingerprint(data, chunk_bytes=1 << 10)


def test_without_duplicates(small):
    kept = E.without_duplicates(small)
    assert kept.columns == small.columns
    ids = [r.doc_id for r in kept.collect()]
    # 7 to 9 are empty without white space, and 9 has the most code points
    assert sorted(i for i in ids if i) == [2, 4, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16, 17] and ids.count(None) == 1


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_links(unique, n, num):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_components(unique, n, num, 100).collect()}
    assert got == links_by_force(rows_of(unique), n, num, 100)


def test_links_over_blocks(spark, sf_dir):
    """A cluster that needs many pairs of blocks: chains of near copies."""
    base = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 20] + [f"x{i}"] + base[i % 20 + 1 :])) for i in range(40)] + [(90, " ".join(base)), (91, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_components(docs, 3, 80, 100, block_sets=5).collect()}
    assert got == links_by_force(rows, 3, 80, 100)


@pytest.mark.parametrize("block_grams", [3, 40])
def test_links_over_empty_blocks(spark, block_grams):
    """More blocks than members: a pair of blocks with an empty side has no links."""
    rows = [(i, " ".join(f"{i // 3}-{k}" for k in range(30 + i % 3))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_components(docs, 3, 90, 100, block_grams=block_grams).collect()}
    assert got == links_by_force(rows, 3, 90, 100)


def test_rows_without_id_and_repeated_rows(small):
    got = J.jaccard_components(small, 3, 90, 100).collect()
    assert len(got) == small.count()
    assert [(r.component_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    assert {r.component_id for r in got if r.doc_id == 4} == {4}


def test_empty_tables(small):
    assert J.jaccard_components(small.limit(0)).count() == 0
    assert E.exact_duplicates(small.limit(0)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=12), st.integers(30, 100))
def test_trie_finds_all_pairs(sets, num):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    got = sorted(J.link_sets(arrays, None, num, 100))
    want = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    assert got == sorted(want)


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=120), st.integers(0, 8), st.integers(0, 8), st.sampled_from([(80, 100), (90, 100)]))
def test_similar_sets_share_a_key(elements, dropped, added, similarity):
    num, den = similarity
    a = sorted(elements)
    b = sorted(set(a[dropped:]) | {(x * 7919 + 13) % 2**64 for x in a[:added]})
    if b and den * len(set(a) & set(b)) >= num * len(set(a) | set(b)):
        keys = [set(J.Segments(num, den).keys(np.array(s, np.uint64)).tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 60), (61, 100), (70, 70), (5, 5)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(51)} | {60: 60, 61: 60, 100: 60, 70: 70}
