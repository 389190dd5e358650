"""Article extraction from landed HTML, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import language

NOT_TEXT = "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BLOCK_TAG = "(?i)</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section|blockquote)(\\s[^>]*)?/?>"
# HTML entities, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for entity, letter in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(letter))
    return c


def plain_text(c: Column) -> Column:
    """Tags removed, block tags as line breaks, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(c, BLOCK_TAG, "\n"), "<[^>]*>", "")
    text = F.regexp_replace(unescape(text), "[ \\t\\r]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " *\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def _meta(html: Column, name: str) -> Column:
    """Content of a meta tag, with its attributes in either order."""
    key = f'(?:name|property)="{name}"'
    after = F.regexp_extract(html, f'(?is)<meta\\s[^>]*{key}[^>]*content="([^"]*)"', 1)
    before = F.regexp_extract(html, f'(?is)<meta\\s[^>]*content="([^"]*)"[^>]*{key}', 1)
    return unescape(F.coalesce(_or_null(after), _or_null(before)))


def extract_articles(pages: DataFrame) -> DataFrame:
    """``url, html`` -> ``url, title, text, top_image, movies, authors, publish_date, language``."""
    html = F.col("html")
    clean = pages.withColumn("clean", F.regexp_replace(html, NOT_TEXT, ""))
    body = F.regexp_extract("clean", "(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.when(body != "", body).otherwise(F.regexp_extract("clean", "(?is)<body[^>]*>(.*)", 1))
    body = F.regexp_replace(body, "(?is)<h1[^>]*>.*?</h1>", "")
    title = plain_text(F.regexp_extract("clean", "(?is)<title[^>]*>(.*?)</title>", 1))
    declared = F.lower(F.regexp_extract(html, '(?is)<html[^>]*\\slang="([a-zA-Z]{2})', 1))
    authors = F.split(F.coalesce(_meta(html, "author"), F.lit("")), ",\\s*")
    parsed = clean.select(
        *[c for c in pages.columns if c != "html"],
        title.alias("title"),
        plain_text(body).alias("text"),
        _meta(html, "og:image").alias("top_image"),
        F.regexp_extract_all(html, F.lit('(?is)<(?:video|iframe|source)\\s[^>]*src="([^"]*)"'), F.lit(1)).alias("movies"),
        F.filter(authors, lambda a: a != "").alias("authors"),
        F.try_to_timestamp(_meta(html, "article:published_time")).alias("publish_date"),
        declared.alias("declared"),
    )
    detected = language(F.concat("title", F.lit(". "), "text"))
    return parsed.withColumn("language", F.coalesce(_or_null(F.col("declared")), detected)).drop("declared")
