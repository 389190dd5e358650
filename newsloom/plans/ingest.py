"""Parsed pages -> deduplicated article rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import first_words
from newsloom.functions.urls import article_id, normalize_url, url_domain, with_scheme
from newsloom.operators.dedup import dedup_new, distinct_ids
from newsloom.session import materialise
from newsloom.sources.links import tag_source

BEGINNING_WORDS = 100


def build_articles(parsed: DataFrame, as_of) -> DataFrame:
    """Stored columns of parsed pages.  ``source_name`` and ``title_embedding`` pass through if present."""
    address = with_scheme(F.col("url"))
    normalized = normalize_url(address)
    return parsed.select(
        article_id(normalized).alias("id"),
        F.col("title").alias("article_title"),
        F.col("text").alias("article_text"),
        first_words(F.col("text"), BEGINNING_WORDS).alias("article_text_beginning"),
        F.col("authors").alias("article_authors"),
        normalized.alias("normalized_url"),
        url_domain(address).alias("normalized_domain"),
        F.col("language").alias("language_code"),
        "publish_date",
        F.lit(as_of).cast("timestamp").alias("first_indexed_date"),
        "top_image",
        "movies",
        address.alias("article_url"),
        *[c for c in ("source_name", "title_embedding", "order_key") if c in parsed.columns],
    )


def ingest(
    parsed: DataFrame,
    store: DataFrame,
    languages: list[str],
    as_of,
    order_by: list[str] | None = None,
    sources: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted articles and rejected rows (no address, no title or wrong language).

    Duplicates are neither: they are known articles.  ``sources`` (source_name, normalized_domain) names
    the source of every article whose site is in it.
    """
    articles = materialise(build_articles(parsed, as_of), "parsed")
    if sources is not None:
        articles = tag_source(articles, sources)
    usable = F.col("normalized_url").isNotNull() & F.col("article_title").isNotNull() & F.col("article_text").isNotNull()
    allowed = F.coalesce(usable & F.col("language_code").isin(languages), F.lit(False))
    reason = F.when(usable, F.lit("language")).otherwise(F.lit("incomplete"))
    rejected = articles.where(~allowed).withColumn("reason", reason)
    fresh = dedup_new(articles.where(allowed), store, order_by or ["normalized_url", "article_url"])
    return distinct_ids(fresh, store), rejected
