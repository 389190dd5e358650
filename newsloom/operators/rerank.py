"""Ordering of the hits of a query: interleaving, relevance rank, timeline, counters.

All windows are per query, whose hits are limited by the retrieval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP = 20
TRIGGER = 5
OLDER_PER_RECENT = 3
FEW_RESULTS = 5


def mark_recent(hits: DataFrame, as_of, recent_days: int = 7) -> DataFrame:
    """``recent`` flag and ``position`` by score; hits without a date count as older."""
    border = F.lit(as_of).cast("timestamp") - F.expr(f"interval {recent_days} days")
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("recent", F.coalesce(F.col("publish_date") >= border, F.lit(False))).withColumn(
        "position", F.row_number().over(order)
    )


def interleave(hits: DataFrame, as_of, recent_days: int = 7) -> DataFrame:
    """Relevance rank (from 0).

    When more than 5 of the top 20 hits are recent, one recent hit is followed by three
    older ones until a list ends; otherwise the score order stays.
    """
    per_query = W.partitionBy("qid")
    in_class = W.partitionBy("qid", "recent").orderBy("position")
    marked = mark_recent(hits, as_of, recent_days)
    recent_on_top = F.count(F.when(F.col("recent") & (F.col("position") <= TOP), 1)).over(per_query)
    place = F.row_number().over(in_class) - 1
    keyed = (
        marked.withColumn("mixed", recent_on_top > TRIGGER)
        .withColumn("place", place)
        .withColumn("cycle", F.when(F.col("recent"), F.col("place")).otherwise(F.floor(F.col("place") / OLDER_PER_RECENT)))
        .withColumn("slot", F.when(F.col("recent"), F.lit(0)).otherwise(1 + F.col("place") % OLDER_PER_RECENT))
    )
    first = F.when(F.col("mixed"), F.col("cycle")).otherwise(F.col("position"))
    second = F.when(F.col("mixed"), F.col("slot")).otherwise(0)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(first, second)) - 1
    return keyed.withColumn("relevance_rank", rank).drop("mixed", "place", "cycle", "slot", "position")


def timeline(hits: DataFrame, n: int = 100) -> DataFrame:
    """Dated hits, newest first; only those with a relevance rank below ``n`` are shown."""
    order = W.partitionBy("qid").orderBy(F.desc("publish_date"), "relevance_rank")
    return (
        hits.where(F.col("publish_date").isNotNull() & (F.col("relevance_rank") < n))
        .withColumn("timeline_position", F.row_number().over(order) - 1)
    )


def search_summary(hits: DataFrame, queries: DataFrame, as_of, recent_days: int = 7) -> DataFrame:
    """Counters per query, and whether to advise a less strict search.

    Queries of search type ``timeline`` show and count dated hits only.
    """
    if "search_type" in queries.columns:
        kinds = queries.select("qid", "search_type").distinct()
        dated = F.col("publish_date").isNotNull() | ~F.col("search_type").eqNullSafe("timeline")
        hits = hits.drop("search_type").join(kinds, "qid").where(dated).drop("search_type")
    marked = mark_recent(hits, as_of, recent_days)
    counts = marked.groupBy("qid").agg(
        F.count("*").alias("n_hits"),
        F.count(F.when(F.col("recent"), 1)).alias("n_recent"),
        F.count(F.when(~F.col("recent"), 1)).alias("n_older"),
        F.count(F.when(F.col("recent") & (F.col("position") <= TOP), 1)).alias("n_recent_in_top"),
    )
    names = ["n_hits", "n_recent", "n_older", "n_recent_in_top"]
    out = queries.join(counts, "qid", "left").select(
        "qid", "strictness", *[F.coalesce(c, F.lit(0)).alias(c) for c in names]
    )
    few = (F.col("n_hits") < FEW_RESULTS) & (F.col("strictness") != "very_lenient_matching")
    return out.withColumn("advise_less_strict", few)
