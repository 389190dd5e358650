"""Home feed: recency times centrality, tagged articles first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.boosts import decay, factor, has_any

REQUIRED_TAG = "centroid_k50"
# Nested bonus clauses: each set of tags that matches adds its multiplier.
TAG_CLAUSES = (
    (["centroid_k5", "centroid_k10", "centroid_k20"], 2.0),
    (["centroid_k5", "centroid_k10"], 2.0),
    (["centroid_k5"], 2.0),
)


def home_score(as_of) -> Column:
    target = F.lit(as_of).cast("timestamp")
    tags = F.col("article_centroid_tags")
    base = F.lit(0.0)
    for names, bonus in TAG_CLAUSES:
        base = base + F.when(has_any(tags, names), F.lit(bonus)).otherwise(0.0)
    recency = factor(decay(F.col("publish_date"), target, offset=24, rate=0.5, scale=12), 0, 1, 0, 2)
    central = factor(F.coalesce("centrality_score_15", F.lit(0.0)), 0.1, 1, 0, 10)
    return F.round(base * recency * central, 9)


def home_feed(articles: DataFrame, as_of, limit: int = 100, start: int = 0) -> DataFrame:
    """Top articles that carry the required tag; a partition keeps only its own best rows."""
    scored = articles.where(has_any(F.col("article_centroid_tags"), [REQUIRED_TAG])).withColumn(
        "score", home_score(as_of)
    )
    return scored.orderBy(F.desc("score"), "id").offset(start).limit(limit)
