"""TF-IDF weights and the per-article feature table of the similarity jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import entity_tokens, first_words, lone_first_words, tokens
from newsloom.session import bounded_broadcast, task_count

ENTITY_TEXT_WORDS = 300
ARTICLES_A_TASK = 10_000

# The three sparse feature sets; the dense one is "vector".
SPARSE_KINDS = ("tfidf", "title_ent", "text_ent")
KINDS = (*SPARSE_KINDS, "vector")


def entity_texts() -> dict[str, Column]:
    """Text whose entity words make up a kind."""
    return {"title_ent": F.col("article_title"), "text_ent": first_words(F.col("article_text"), ENTITY_TEXT_WORDS)}


def similarity_texts() -> dict[str, Column]:
    """Text of each sparse kind.  Title and beginning are joined without a separator."""
    title = F.col("article_title")
    return {
        "tfidf": F.concat(F.coalesce(title, F.lit("")), F.coalesce("article_text_beginning", F.lit(""))),
        **{kind: F.array_join(entity_tokens(text), " ") for kind, text in entity_texts().items()},
    }


def with_gazetteer(articles: DataFrame, gazetteer: DataFrame, text_col: str) -> DataFrame:
    """Add ``entities``: entity words, and lone sentence starts that are known names (column ``word``)."""
    lone = articles.select("id", F.explode_outer(lone_first_words(F.col(text_col))).alias("word"))
    known = (
        lone.where(F.col("word").isNotNull())
        .join(bounded_broadcast(gazetteer.select("word").distinct()), "word", "left_semi")
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("word")).alias("known"))
    )
    extra = F.coalesce("known", F.array().cast("array<string>"))
    entities = F.concat(entity_tokens(F.col(text_col)), extra)
    return articles.join(known, "id", "left").withColumn("entities", entities).drop("known")


def idf_table(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """Smoothed inverse document frequency of every term of a corpus."""
    size = corpus.agg(F.count("*").alias("n")).scalar()
    terms = corpus.select(F.explode_outer(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return (
        terms.where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .select("term", "df", (F.log((1 + size) / (1 + F.col("df"))) + 1).alias("idf"))
    )


def _own_idf(counts: DataFrame) -> DataFrame:
    """IDF fitted on the compared articles themselves, per day and feature set."""
    df = counts.groupBy("day", "kind", "term").agg(F.count("*").alias("df"))
    size = counts.groupBy("day", "kind").agg(F.count_distinct("id").alias("n"))
    return df.join(F.broadcast(size), ["day", "kind"]).select(
        "day", "kind", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")
    )


def term_counts(articles: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``(day, id, kind, term, tf)``.

    Articles are spread by ``id`` before their terms are unfolded, so counting needs no
    further shuffle and a frequent term never gathers in one task; a task counts a bounded number
    of articles on average, however many there are.  The outer explode keeps
    the optimizer from evaluating the tokens a second time in an inferred filter.
    """

    def tagged(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    pairs = F.concat(*[tagged(kind) for kind in texts])
    return (
        # the kinds of the terms do not travel
        articles.select("day", "id", *[tokens(text).alias(f"_{kind}") for kind, text in texts.items()])
        .repartition(max(task_count(articles), -(-articles.count() // ARTICLES_A_TASK)), "id")
        .select("day", "id", F.explode_outer(pairs).alias("pair"))
        .where(F.col("pair").isNotNull())
        .select("day", "id", "pair.kind", "pair.term")
        .groupBy("day", "id", "kind", "term")
        .agg(F.count("*").alias("tf"))
    )


def tfidf_weights(
    articles: DataFrame, idf: DataFrame | None, texts: dict[str, Column] | None = None
) -> DataFrame:
    """Unit-length TF-IDF rows as arrays: ``day, id, <kind>_terms, <kind>_weights``.

    ``idf`` comes from a generic corpus, and terms it lacks are dropped; ``None`` fits it
    on the articles themselves.
    """
    texts = texts or similarity_texts()
    counts = term_counts(articles, texts)
    if idf is None:
        weighted = counts.join(_own_idf(counts), ["day", "kind", "term"])
    else:
        weighted = counts.join(bounded_broadcast(idf.select("term", "idf")), "term")
    weight = F.col("tf") * F.col("idf")
    sums = []
    for kind in texts:
        mine = F.col("kind") == kind
        sums.append(F.collect_list(F.when(mine, F.struct("term", weight.alias("weight")))).alias(kind))
        sums.append(F.sqrt(F.sum(F.when(mine, weight * weight))).alias(f"{kind}_norm"))
    rows = weighted.groupBy("day", "id").agg(*sums)

    def unit_length(kind: str) -> Column:
        norm = F.col(f"{kind}_norm")
        return F.transform(f"{kind}.weight", lambda w: w / norm)

    out = [F.col("day"), F.col("id")]
    for kind in texts:
        out += [F.col(f"{kind}.term").alias(f"{kind}_terms"), unit_length(kind).alias(f"{kind}_weights")]
    return rows.select(*out)


def feature_table(
    articles: DataFrame,
    idf: DataFrame | None,
    kinds: tuple[str, ...] = KINDS,
    source_col: str = "normalized_domain",
    entities: DataFrame | None = None,
) -> DataFrame:
    """One row per article: ``day, id, source, ts`` and the arrays of the wanted kinds.

    Articles without any known term keep a row with empty arrays.  ``entities`` (``id`` and the entity words
    of each entity kind) takes the place of the words found by capitals alone.
    """
    articles = articles.withColumn("day", F.to_date("publish_date"))
    base = articles.select(
        "day",
        "id",
        F.coalesce(source_col, F.lit("")).alias("source"),
        F.col("publish_date").alias("ts"),
        *([F.col("title_embedding").alias("vector")] if "vector" in kinds else []),
    ).where(F.col("day").isNotNull())
    texts = {k: t for k, t in similarity_texts().items() if k in kinds}
    if not texts:
        return base
    if entities is not None:
        named = [k for k in entity_texts() if k in kinds]
        articles = articles.join(entities.select("id", *[F.col(k).alias(f"_{k}") for k in named]), "id", "left")
        texts.update({k: F.coalesce(f"_{k}", F.lit("")) for k in named})
    # both sides are spread by id alone, so the weights are not shuffled again
    return base.join(tfidf_weights(articles, idf, texts).drop("day"), "id", "left")
