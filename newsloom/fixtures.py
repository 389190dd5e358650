"""Article and query views over the driver tables, for the registered queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import first_words
from newsloom.functions.urls import normalize_url, url_domain
from newsloom.session import scratch_path, spread


TITLE_WORDS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def articles(spark: SparkSession, sf_dir: str, words: int | None = None) -> DataFrame:
    """Documents as articles, dated by the event of the same number.

    ``words``: a job that looks at no more words of a text takes only these to their events.
    """
    documents = spread(table(spark, sf_dir, "documents"))
    if words is not None:
        documents = documents.withColumn("text", first_words(F.col("text"), words))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", "value")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    url = F.concat(
        F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")
    )
    return (
        documents.join(events, "doc_id")
        .join(vectors, "doc_id", "left")
        .select(
            F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"),
            "doc_id",
            first_words(F.col("text"), TITLE_WORDS).alias("article_title"),
            F.col("text").alias("article_text"),
            first_words(F.col("text"), 100).alias("article_text_beginning"),
            F.array(F.concat(F.lit("author"), (F.col("doc_id") % 37).cast("string"))).alias("article_authors"),
            url.alias("article_url"),
            normalize_url(url).alias("normalized_url"),
            url_domain(url).alias("normalized_domain"),
            F.col("source").alias("source_name"),
            F.col("lang").alias("language_code"),
            F.col("ts").alias("publish_date"),
            F.col("embedding").alias("title_embedding"),
            F.col("value").alias("event_value"),
        )
    )


# Event values above which the scored view gives a tag: plain fixture constants.
TAG_CUTS = {"centroid_k50": 30.0, "centroid_k20": 60.0, "centroid_k10": 90.0, "centroid_k5": 120.0}


def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a stand-in centrality and tags, so ranking can be tested on its own.

    Event values below 5 stand for articles that were never analysed.
    """
    value = F.col("event_value")
    tags = F.array(*[F.when(value > cut, F.lit(name)) for name, cut in TAG_CUTS.items()])
    return (
        articles(spark, sf_dir)
        .withColumn("centrality_score_15", F.when(value >= 5, value / (value + 100)))
        .withColumn("article_centroid_tags", F.array_compact(tags))
    )


def corpus_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.operators.features import idf_table

    return idf_table(table(spark, sf_dir, "benchmark"))


def search_queries(
    spark: SparkSession, sf_dir: str, strictness: str = "strict_matching", search_type: str = "timeline"
) -> DataFrame:
    """One query per benchmark passage: its whole text; long and short passages bring date limits."""
    items = table(spark, sf_dir, "benchmark")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    chars = F.length("text")
    return items.join(vectors, "item_id", "left").select(
        F.concat(F.lit("q"), F.lpad(F.col("item_id").cast("string"), 8, "0")).alias("qid"),
        F.col("text").alias("q"),
        F.when(chars > 250, "2024-01-02").otherwise("").alias("min_date"),
        F.when(chars < 150, "2024-01-02").otherwise("").alias("max_date"),
        F.lit(strictness).alias("strictness"),
        F.lit(search_type).alias("search_type"),
        F.lit(None).cast("timestamp").alias("target_date"),
        F.col("embedding").alias("query_embedding"),
    )


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed pages; documents of one source, language and length share an address."""
    documents = spread(table(spark, sf_dir, "documents"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    address = F.concat_ws(
        "/", F.concat(F.lit("http://www."), "source", F.lit(".example.com")), "lang", F.col("n_chars").cast("string")
    )
    return documents.join(events, "doc_id").select(
        address.alias("url"),
        first_words(F.col("text"), 12).alias("title"),
        "text",
        F.lit(None).cast("string").alias("top_image"),
        F.array().cast("array<string>").alias("movies"),
        F.array(F.concat(F.lit("author"), (F.col("doc_id") % 37).cast("string"))).alias("authors"),
        F.col("ts").alias("publish_date"),
        F.col("lang").alias("language"),
        F.col("doc_id").alias("order_key"),
    )


def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link-dump lines: page addresses in files by the hour of the event of the same number."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), "url", "html")
    hours = table(spark, sf_dir, "events").select("event_id", "ts")
    links = F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0)))
    cells = [F.date_format("ts", "yyyyMMddHHmmss"), F.col("event_id").cast("string"), F.lit("0"), links.cast("string")]
    return pages.join(hours, "event_id").select(
        F.concat(F.date_format("ts", "yyyyMMddHH"), F.lit("0000.LINKS.TXT.gz")).alias("file_name"),
        F.concat_ws("\t", *cells, "url", F.lit("end")).alias("value"),
    )


def domain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain list: the front pages of all sites that have an ``.html`` address."""
    pages = table(spark, sf_dir, "pages").where(F.col("url").endswith(".html"))
    return pages.select(F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/")).alias("value"))


def link_dumps(spark: SparkSession, sf_dir: str) -> str:
    """The link lines as gzip files of their names, one per hour, in a folder of their own."""
    lines = link_lines(spark, sf_dir)
    made, folder = scratch_path(spark, "dump-lines"), scratch_path(spark, "dumps")
    lines.repartition("file_name").write.partitionBy("file_name").option("compression", "gzip").text(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    for status in system.globStatus(path(f"{made}/file_name=*/part-*")):
        name = status.getPath().getParent().getName().removeprefix("file_name=")
        system.rename(status.getPath(), path(f"{folder}/{name}"))
    return folder
