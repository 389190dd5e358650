"""Ordering of hits and the strictness levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom import fixtures as X
from newsloom.functions.text import first_words
from newsloom.operators import fuzzy, rerank
from newsloom.operators.retrieval import in_date_range, vector_topk
from newsloom.plans import search as S
from newsloom.plans.home import home_feed

AS_OF = "2024-01-10 00:00:00"


def ranked_hits(spark, n_recent, n_older):
    rows = [("q", f"r{i:02}", 100.0 - i, "2024-01-09 00:00:00") for i in range(n_recent)]
    rows += [("q", f"o{i:02}", 50.0 - i, "2023-01-01 00:00:00") for i in range(n_older)]
    df = spark.createDataFrame(rows, "qid string, id string, score double, ts string")
    return df.withColumn("publish_date", F.col("ts").cast("timestamp"))


def order_of(df):
    return [r["id"] for r in df.orderBy("relevance_rank").collect()]


def test_five_recent_hits_keep_the_order(spark):
    hits = ranked_hits(spark, 5, 4)
    assert order_of(rerank.interleave(hits, AS_OF)) == ["r00", "r01", "r02", "r03", "r04", "o00", "o01", "o02", "o03"]


def test_six_recent_hits_are_mixed_one_to_three(spark):
    got = order_of(rerank.interleave(ranked_hits(spark, 6, 7), AS_OF))
    assert got == ["r00", "o00", "o01", "o02", "r01", "o03", "o04", "o05", "r02", "o06", "r03", "r04", "r05"]


def test_only_recent_hits(spark):
    assert order_of(rerank.interleave(ranked_hits(spark, 8, 0), AS_OF)) == [f"r{i:02}" for i in range(8)]


def test_missing_date_counts_as_older(spark):
    hits = ranked_hits(spark, 1, 0).withColumn("publish_date", F.lit(None).cast("timestamp"))
    assert rerank.interleave(hits, AS_OF).first()["recent"] is False
    assert rerank.timeline(rerank.interleave(hits, AS_OF)).count() == 0


def test_timeline_is_newest_first(spark):
    shown = rerank.timeline(rerank.interleave(ranked_hits(spark, 6, 7), AS_OF), n=4).orderBy("timeline_position").collect()
    assert [r["id"] for r in shown] == ["r00", "o00", "o01", "o02"]


def test_summary_advice(spark):
    queries = spark.createDataFrame([("q", "strict_matching"), ("none", "very_lenient_matching")], "qid string, strictness string")
    rows = {r["qid"]: r for r in rerank.search_summary(ranked_hits(spark, 2, 1), queries, AS_OF).collect()}
    assert (rows["q"]["n_hits"], rows["q"]["n_recent"], rows["q"]["advise_less_strict"]) == (3, 2, True)
    assert (rows["none"]["n_hits"], rows["none"]["advise_less_strict"]) == (0, False)


def test_strictness_levels_are_nested_and_unknown_gives_nothing(spark, sf_dir):
    articles = X.scored_articles(spark, sf_dir)
    base = X.search_queries(spark, sf_dir).where("qid <= 'q00000003'").drop("strictness").withColumn("q", first_words(F.col("q"), 3))
    levels = spark.createDataFrame([(x,) for x in (*S.LEVELS, "unknown")], "strictness string")
    queries = base.join(F.broadcast(levels)).withColumn("base", F.col("qid")).withColumn("qid", F.concat("qid", F.lit("|"), "strictness"))
    empty = queries.where("qid like 'q00000000%'").withColumn("q", F.lit("")).withColumn("qid", F.concat(F.lit("e"), "qid"))
    hits = S.search_hits(articles, queries.unionByName(empty), "2024-01-04 00:00:00").collect()
    sets = {}
    for r in hits:
        name, level = r["qid"].split("|")
        sets.setdefault(level, set()).add((name, r["id"]))
    assert "unknown" not in sets and not any(r["qid"].startswith("e") for r in hits)
    assert sets["strict_matching"] <= sets["lenient_matching"] <= sets["very_lenient_matching"]


def test_scores_over_arrays(monkeypatch):
    rnd = np.random.default_rng(4)
    words = [f"{a}{b}ing" for a in ("read", "lead", "bread", "thread", "reed") for b in ("", "er", "y", "s")]
    words += ["", "a", "b", "ab", "ba", "martha", "marhta", "dwayne", "duane", "dixon", "dicksonx", "x" * 40, "xy" * 30, "naïve", "naive", "中文", "中"]
    words += ["".join(rnd.choice(list("abc"), rnd.integers(1, 34))) for _ in range(60)]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    monkeypatch.setattr(fuzzy, "SCORE_PAIRS", 777)
    got = fuzzy.pair_scores(words, words, left, right)
    assert got == pytest.approx([fuzzy.jaro_winkler(words[i], words[j]) for i, j in zip(left, right, strict=True)], abs=1e-12)
    assert (fuzzy.pair_bounds(words, words, left, right) >= got - 1e-12).all()


def test_best_scores_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "BATCH_PAIRS", 5)
    rows = [("a", "Reading lists", "bread and threads"), ("b", "Nothing alike", None), ("c", None, None), ("d", "zzz", "reading")]
    articles = spark.createDataFrame(rows, "id string, article_title string, article_text_beginning string")
    queries = spark.createDataFrame([("q", "Reader of threads", False), ("t", "reading", True), ("e", "--", False)], "qid string, q string, title_only boolean")
    hits = spark.createDataFrame([(q, r[0]) for q in "qte" for r in rows], "qid string, id string")
    got = {(r.qid, r.id, r.query_token): r.best for r in fuzzy.token_scores(hits, articles, queries).collect()}
    want = {}
    for name, title, beginning in rows:
        for qid, asked, title_only in (("q", ("reader", "of", "threads"), False), ("t", ("reading",), True)):
            text = (title or "") + ("" if title_only else beginning or "")
            words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split()]
            want.update({(qid, name, q): max((fuzzy.jaro_winkler(q, w) for w in words), default=0.0) for q in asked})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(0 < v < 0.9 for v in want.values())


def test_home_feed_pages(spark, sf_dir):
    articles = X.scored_articles(spark, sf_dir)
    whole = [r["id"] for r in home_feed(articles, "2024-01-04 00:00:00", limit=20).collect()]
    second = [r["id"] for r in home_feed(articles, "2024-01-04 00:00:00", limit=10, start=10).collect()]
    assert whole[10:] == second


def test_a_bad_date_fails_its_own_query_only(spark):
    rows = [("2024-01-01", ""), ("no date", ""), ("", "2024-13-77"), (None, None), ("2024-01-03", "2024-01-02")]
    dates = spark.createDataFrame(rows, "low string, high string").withColumn("ts", F.lit("2024-01-02 12:00:00").cast("timestamp"))
    got = [r["x"] for r in dates.select(in_date_range(F.col("ts"), F.col("low"), F.col("high")).alias("x")).collect()]
    assert got == [True, False, False, True, False]


def test_undated_hits_are_not_counted_in_a_timeline(spark):
    hits = ranked_hits(spark, 2, 1).unionByName(ranked_hits(spark, 1, 0).withColumns({"id": F.lit("x"), "publish_date": F.lit(None).cast("timestamp")}))
    for kind, n in (("timeline", 3), ("relevance", 4)):
        queries = spark.createDataFrame([("q", "strict", kind)], "qid string, strictness string, search_type string")
        row = rerank.search_summary(hits, queries, AS_OF).first()
        assert (row["n_hits"], row["n_recent"]) == (n, 2)


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 3)).tolist()  # many ties
    articles = spark.createDataFrame([(f"a{i:02}", [float(x) for x in v] if i % 9 else None) for i, v in enumerate(vectors)], "id string, title_embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors[:8])] + [("none", None)], "qid string, query_embedding array<float>")

    def unit(v):
        v = np.array(v, float)
        return v / (np.linalg.norm(v) or 1.0)

    want = set()
    for i, q in enumerate(vectors[:8]):
        found = sorted((-round(float(unit(q) @ unit(v)), 9), f"a{j:02}") for j, v in enumerate(vectors) if j % 9)[:4]
        want |= {(f"q{i}", name, rank) for rank, (_, name) in enumerate(found, 1)}
    for block in (3, 512):
        got = vector_topk(articles.repartition(4), queries, k=4, block=block)
        assert {(r["qid"], r["id"], r["rank"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
