"""Registered queries against their SQL oracles; all of them with ``NEWSLOOM_ALL=1``."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from newsloom.catalog import REGISTRY
from newsloom.oracle.sql import ORACLES

QUICK = (
    "url_normalize tokens entity_tokens char_ngrams lang_detect link_filter new_urls_per_file html_extract "
    "build_articles dedup_new writeback tfidf_weights similarity_threshold interval_similarity similar_articles "
    "daily_analysis home_feed bm25_search vector_topk vector_ann_recall search_strict interleave stream_ingest stream_analysis "
    "stream_day_counts entity_phrases gazetteer_analysis page_links"
).split()


def test_every_query_has_an_oracle():
    # approximate hits cannot be written in SQL; their recall is another query
    assert set(REGISTRY) - {"vector_ann"} == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("NEWSLOOM_ALL") else QUICK)
def test_query(spark, sf_dir, name):
    mine = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = connect(sf_dir).execute(entry.oracle_sql()[name]).df()
    assert len(mine) > 0
    assert difference(mine, theirs) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
