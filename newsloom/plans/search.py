"""Search: retrieve, fuzzy filter by strictness, re-order.  One job answers a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import fuzzy, rerank
from newsloom.operators.retrieval import guard, retrieve
from newsloom.session import BROADCAST_ROWS, bounded_broadcast, materialise

LEVELS = ("very_strict_matching", "strict_matching", "lenient_matching", "very_lenient_matching")
RESULTS = 500


def fuzzy_filter(hits: DataFrame, articles: DataFrame, queries: DataFrame) -> DataFrame:
    """Keep the hits whose text is close enough to the query, by the strictness of the query.

    All words must be close (very strict: to the title; strict: to title and beginning), or
    one word (lenient); very lenient keeps everything.  Queries of another level get nothing.
    """
    levels = guard(queries).select(
        "qid", "q", "strictness", (F.col("strictness") == LEVELS[0]).alias("title_only")
    )
    hits = hits.join(bounded_broadcast(levels.select("qid", "strictness")), "qid")
    free = hits.where(F.col("strictness") == LEVELS[3])
    bound = hits.where(F.col("strictness").isin(*LEVELS[:3]))
    scores = fuzzy.article_scores(bound, _articles_of(bound, articles), levels.where(F.col("strictness").isin(*LEVELS[:3])))
    decisive = F.when(F.col("strictness") == LEVELS[2], F.col("best_token")).otherwise(F.col("worst_token"))
    kept = bound.join(scores, ["qid", "id"]).where(decisive > fuzzy.CUTOFF)
    return kept.select(hits.columns).unionByName(free)


def _articles_of(hits: DataFrame, articles: DataFrame) -> DataFrame:
    """The articles of the hits only, when few ids can travel to them; else all."""
    ids = hits.select("id").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return articles.join(F.broadcast(ids), "id", "left_semi") if few else articles


def search_hits(articles: DataFrame, queries: DataFrame, as_of, limit: int = RESULTS) -> DataFrame:
    """Hits of every query after the fuzzy filter, with their score."""
    hits = materialise(retrieve(articles, queries, as_of, limit), "hits")
    return fuzzy_filter(hits, articles, queries)


def search(articles: DataFrame, queries: DataFrame, as_of, recent_days: int = 7) -> DataFrame:
    """Complete search with relevance rank; timeline searches drop undated hits."""
    hits = search_hits(articles, queries, as_of)
    kinds = queries.select("qid", "search_type")
    hits = hits.join(bounded_broadcast(kinds), "qid").where(
        (F.col("search_type") != "timeline") | F.col("publish_date").isNotNull()
    )
    return rerank.interleave(hits, as_of, recent_days)
