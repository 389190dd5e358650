"""Historical URL discovery: hourly link dumps -> distinct URL list of the known domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import links


def _names(spark: SparkSession, folder: str) -> set[str]:
    """Names of the dump files of a folder: one per hour at most."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{links.FILE_SUFFIX}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return {status.getPath().getName() for status in found or []}


def historical_urls(spark: SparkSession, folder: str, domains: DataFrame, start: str, end: str, skip_hours: int = 12) -> DataFrame:
    """``url, domain_name`` of the dumps in ``folder`` that belong to the hour grid of the span.

    Only the files of the grid are read; hours without a dump are left out.
    """
    span = spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    present = _names(spark, folder)
    wanted = [r["file_name"] for r in links.hour_grid(span, skip_hours).select("file_name").collect()]
    paths = [f"{folder}/{name}" for name in sorted(wanted) if name in present]
    if not paths:
        return spark.createDataFrame([], "url string, domain_name string")
    good, _ = links.scan_links(spark, paths)
    return links.filter_links(good, domains)
