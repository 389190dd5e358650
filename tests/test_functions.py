"""Golden rows of the scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions import boosts, text, urls
from newsloom.operators.fuzzy import jaro_winkler, pair_bounds, pair_scores


def apply(spark, function, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_normalize_url(spark):
    cases = {
        "HTTPS://WWW.Site.com/A?x=1#y": "https://site.com/a",
        "https://site.com/a#b?c": "https://site.com/a",
        "http://www.site.com/index.html": "https://site.com",
        "https://site.com/index.html/": "https://site.com/index.html",
        "https://site.com/http://www.other.com/": "https://site.com/https://www.other.com",
        "https://site.com/a//": "https://site.com/a/",
        "site.com/a/": "site.com/a",
        "": None,
        "/": None,
    }
    assert apply(spark, urls.normalize_url, list(cases)) == list(cases.values())


def test_normalize_is_idempotent(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(urls.normalize_url(F.col("url")).alias("u"))
    assert pages.where(urls.normalize_url(F.col("u")) != F.col("u")).count() == 0


def test_domains_and_link_forms(spark):
    assert apply(spark, urls.url_domain, ["https://www.a.com/x", "http://a.www.com?q", "a.com#f", "A.com"]) == [
        "a.com", "a.com", "a.com", "a.com",
    ]
    assert apply(spark, urls.link_domain, [" https://www.a.com/x ", "a.com#f", "a.com?q/x"]) == ["a.com", "a.com#f", "a.com"]
    assert apply(spark, urls.link_url, ["https://www.A.com/x/?q", "http://a.com/#f", "https://", "/"]) == [
        "www.A.com/x", "a.com/#f", None, None,
    ]
    assert apply(spark, urls.with_scheme, ["a.com", "http://a.com"]) == ["https://a.com", "http://a.com"]
    assert apply(spark, urls.article_id, ["https://A.com/b.html"]) == ["a_com_b_html"]


def test_tokens(spark):
    assert apply(spark, text.tokens, ["Él a_b x ß2 Straße, l'été", None, ""]) == [
        ["el", "a_b", "ß2", "straße", "ete"], [], [],
    ]


def test_char_ngrams(spark):
    assert apply(spark, text.char_ngrams, ["abcd", "ab", "a"]) == [
        ["ab", "bc", "cd", "abc", "bcd", "abcd"], ["ab"], [],
    ]


def test_fuzzy_tokens(spark):
    assert apply(spark, text.fuzzy_tokens, [" Foo-Bar  baz! - "]) == [["foo bar", "baz"]]


def test_entity_tokens(spark):
    got = apply(spark, text.entity_tokens, ["Elon Musk did this. The cat saw (Anna) O'Hara. Then it\nRain fell", "Paris"])
    assert got == [["elon", "musk", "anna", "ohara"], []]


def test_first_words(spark):
    assert apply(spark, lambda c: text.first_words(c, 2), ["a  b c", "a"]) == ["a ", "a"]


def test_language(spark):
    got = apply(spark, text.language, ["the cat and the dog", "der Hund und die Katze", "12345", "el perro y la casa"])
    assert got == ["en", "de", "und", "es"]


@pytest.mark.parametrize("hours,expected", [(0, 1.0), (24, 1.0), (36, 0.5), (48, 0.25), (-36, 0.5)])
def test_decay(spark, hours, expected):
    target = F.lit("2024-01-10 00:00:00").cast("timestamp")
    ts = target - F.expr(f"interval {hours} hours")
    value = spark.range(1).select(boosts.decay(ts, target, 24, 0.5, 12)).first()[0]
    assert math.isclose(value, expected, abs_tol=1e-12)


def test_factor_clamps_and_missing_values(spark):
    one = spark.range(1)
    assert one.select(boosts.factor(F.lit(5.0), 1, 2, 1, 10)).first()[0] == 10.0
    assert one.select(boosts.factor(F.lit(-5.0), 1, 2, 1, 10)).first()[0] == 1.0
    null_date = boosts.decay(F.lit(None).cast("timestamp"), F.current_timestamp(), 24, 0.5, 12)
    assert one.select(null_date).first()[0] == 0.0
    vector = F.array(F.lit(1.0), F.lit(0.0))
    assert one.select(boosts.cosine(F.lit(None).cast("array<float>"), vector)).first()[0] == 0.0


def test_jaro_winkler_known_values():
    assert math.isclose(jaro_winkler("martha", "marhta"), 0.9611111111, abs_tol=1e-9)
    assert math.isclose(jaro_winkler("dixon", "dicksonx"), 0.8133333333, abs_tol=1e-9)
    assert jaro_winkler("abc", "xyz") == 0.0
    assert jaro_winkler("été", "été") == 1.0


def test_scores_of_real_words_and_their_bounds(spark, sf_dir):
    words = (
        spark.read.parquet(f"{sf_dir}/documents.parquet")
        .select(F.explode(text.fuzzy_tokens(F.col("text"))).alias("w"))
        .distinct().orderBy("w").limit(1500).toPandas()["w"].tolist()
    )
    asked = words[::60]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(asked)), np.arange(len(words))))
    scores = pair_scores(asked, words, left, right)
    brute = [jaro_winkler(asked[i], words[j]) for i, j in zip(left, right, strict=True)]
    assert np.abs(scores - brute).max() < 1e-12
    assert (pair_bounds(asked, words, left, right) >= scores - 1e-12).all()
