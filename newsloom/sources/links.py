"""Link dumps, URL lists, domain lists and the source dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.urls import link_domain, link_url, url_domain
from newsloom.session import bounded_broadcast

# Fixed values of the dump format: the address is the fifth column; hourly file names.
URL_COLUMN = 4
FILE_SUFFIX = "0000.LINKS.TXT.gz"


def hour_grid(spans: DataFrame, skip_hours: int = 12) -> DataFrame:
    """Expected dump files of each ``start .. end`` span: ``ts, file_name``.

    Hours restart at 0 every day, and only valid dates occur.
    """
    days = spans.select(F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("day"))
    hours = F.explode(F.sequence(F.lit(0), F.lit(23), F.lit(skip_hours)))
    return (
        days.distinct()
        .select("day", hours.alias("hour"))
        .select(
            (F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("hour"))).alias("ts"),
        )
        .withColumn("file_name", F.concat(F.date_format("ts", "yyyyMMddHH"), F.lit(FILE_SUFFIX)))
    )


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed links ``file_name, url`` and the lines too short to hold an address."""
    cells = lines.select("file_name", "value", F.get(F.split("value", "\t"), F.lit(URL_COLUMN)).alias("url"))
    good = cells.where(F.col("url").isNotNull()).select("file_name", "url")
    return good, cells.where(F.col("url").isNull()).select("file_name", "value")


def scan_links(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """All links of gzip TSV dumps, and the rejected lines.  A gzip file is one task."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return split_lines(lines)


def present_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose ``file_name`` occurs in ``files``: grid entries with a dump, or links of grid files."""
    return rows.join(bounded_broadcast(files.select("file_name").distinct()), "file_name", "left_semi")


def domain_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """Domain list lines -> ``domain_name``; empty lines are dropped."""
    return (
        lines.select(link_domain(F.substring_index(F.trim(column), " ", 1)).alias("domain_name"))
        .where(F.col("domain_name") != "")
        .distinct()
    )


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return domain_names(spark.read.text(path))


def listed_links(links: DataFrame, domains: DataFrame) -> DataFrame:
    """``file_name, url`` of the listed domains, in the form of the URL list."""
    return (
        links.withColumn("domain_name", link_domain(F.col("url")))
        .join(bounded_broadcast(domains), "domain_name", "left_semi")
        .select("file_name", link_url(F.col("url")).alias("url"))
        .where(F.col("url").isNotNull())
    )


def filter_links(links: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct listed addresses over all files: ``url, domain_name``."""
    return (
        listed_links(links, domains)
        .select("url")
        .distinct()
        .withColumn("domain_name", link_domain(F.col("url")))
    )


def new_urls_per_file(listed: DataFrame) -> DataFrame:
    """Number of addresses first seen in each file, in file-name order: ``file_name, n_new``."""
    first_seen = listed.groupBy("url").agg(F.min("file_name").alias("file_name"))
    counts = first_seen.groupBy("file_name").agg(F.count("*").alias("n_new"))
    files = listed.select("file_name").distinct()
    return files.join(counts, "file_name", "left").select("file_name", F.coalesce("n_new", F.lit(0)).alias("n_new"))


def write_url_list(urls: DataFrame, path: str) -> None:
    urls.select("url", "domain_name").write.mode("errorifexists").csv(path, header=True)


ORDER_BUCKETS = 4096


def ordered_parts(urls: DataFrame, partitions: int, seed: int) -> DataFrame:
    """``url, position, part``: a random order that ``seed`` fixes, in parts at most one row apart.

    The order is that of a hash of the address, then the address; equal rows follow each other.  Positions
    are counted per range of the hash, so that no task sorts more than its range.
    """
    hashed = urls.select("url").withColumn("_hash", F.xxhash64("url", F.lit(seed)))
    bucket = F.shiftright("_hash", 52) + ORDER_BUCKETS // 2
    placed = hashed.withColumn("_bucket", bucket.cast("int"))
    counts = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most 4096 rows
    counts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy()).alias("_all"),
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", "url")) - 1
    position = (F.col("_before") + inside).alias("position")
    numbered = placed.join(F.broadcast(counts), "_bucket").select("url", position, "_all")
    part = F.expr(f"position * {int(partitions)} div _all").cast("int")
    return numbered.select("url", "position", part.alias("part"))


def read_url_list(
    spark: SparkSession, path: str, shuffle_seed: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Column ``url`` of a URL list; with a seed in random order, split evenly in that order."""
    urls = spark.read.csv(path, header=True).select("url")
    if shuffle_seed is None:
        return urls.repartition(partitions) if partitions else urls
    n = partitions or urls.rdd.getNumPartitions()
    dealt = ordered_parts(urls, n, shuffle_seed)
    return dealt.repartitionByRange(n, "part").sortWithinPartitions("position").select("url")


def write_ordered_parts(urls: DataFrame, path: str, partitions: int, seed: int) -> None:
    """A folder per part, each with its addresses in order."""
    dealt = ordered_parts(urls, partitions, seed).repartition(partitions, "part").sortWithinPartitions("part", "position")
    dealt.write.mode("errorifexists").partitionBy("part").csv(path, header=True)


def sources_from_config(spark: SparkSession, path: str) -> DataFrame:
    """Source dimension ``source_name, domain`` from a YAML configuration."""
    import yaml

    with open(path) as file:
        config = yaml.safe_load(file)
    rows = [(name, info["domain"]) for name, info in config["news_sources"].items()]
    sources = spark.createDataFrame(rows, "source_name string, domain string")
    return sources.select("source_name", url_domain(F.col("domain")).alias("normalized_domain"))


def tag_source(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Set ``source_name`` where the site is a configured source; null elsewhere."""
    return articles.drop("source_name").join(bounded_broadcast(sources), "normalized_domain", "left")


# a link element with its address in double quotes, single quotes or none
ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def without_steps(link: Column) -> Column:
    """Address whose path has no ``.`` and ``..`` steps, however many there were; query and fragment stay."""
    head = F.regexp_extract(link, "(?i)^(https?://[^/?#]*)", 1)
    path = F.regexp_extract(link, "(?i)^https?://[^/?#]*([^?#]*)", 1)
    tail = F.regexp_extract(link, "(?s)^[^?#]*(.*)$", 1)
    names = F.slice(F.split(path, "/"), 2, 1 << 30)
    # a step at the end leaves its folder
    names = F.when(path.rlike(r"/\.\.?$"), F.concat(names, F.array(F.lit("")))).otherwise(names)

    def step(kept: Column, name: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(name == ".", kept).when(name == "..", up).otherwise(F.concat(kept, F.array(name)))

    kept = F.aggregate(names, F.array().cast("array<string>"), step)
    return F.when(path.contains("/."), F.concat(head, F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(link)


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page that stay on its own site: ``url, link``.

    Addresses relative to the page, its folder or its site are resolved; other schemes and links to a
    place in the same page are left out.
    """
    hrefs = F.explode_outer(F.array_distinct(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))))
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    page = F.regexp_extract("url", "^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(page, "(?s)^(.*/)", 1))
    bare = F.trim(F.regexp_replace("href", "^[\"']|[\"']$", ""))
    address = F.replace(bare, F.lit("&amp;"), F.lit("&"))

    def resolve(href: Column) -> Column:
        return (
            F.when(href.rlike("^(?i)https?://"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract("url", "^(https?:)", 1), href))
            .when(href.rlike("^(#|$)") | href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(href.startswith("/"), F.concat("root", href))
            .when(href.startswith("?"), F.concat("page", href))
            .otherwise(F.concat("folder", href))
        )

    return (
        pages.select("url", root.alias("root"), page.alias("page"), folder.alias("folder"), hrefs.alias("href"))
        .select("url", "root", "page", "folder", address.alias("href"))
        .select("url", resolve(F.col("href")).alias("link"))
        .select("url", without_steps(F.col("link")).alias("link"))
        .where(url_domain(F.col("link")) == url_domain(F.col("url")))
        .distinct()
    )
