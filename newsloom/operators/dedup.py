"""Deduplication on the normalised address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.session import bounded_broadcast, materialise


def first_wins(batch: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """First article of every address.

    The rank filter is pushed below the shuffle, so however many copies an address has,
    a partition sends one of them.
    """
    order = W.partitionBy("normalized_url").orderBy(*order_by)
    return batch.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") == 1).drop("_copy")


def dedup_new(batch: DataFrame, store: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """Articles of the batch that the store does not have yet, first copy only.

    The batch is evaluated once and written.  The store streams past its addresses; only the addresses
    found there are compared.
    """
    fresh = materialise(first_wins(batch, order_by), "batch")
    asked = fresh.select("normalized_url")
    known = store.select("normalized_url").join(bounded_broadcast(asked), "normalized_url", "left_semi").distinct()
    return fresh.join(known, "normalized_url", "left_anti")


def distinct_ids(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Make ids unique: two addresses can map to one id, the later one gets a hash suffix.

    An id already in the store keeps its owner; inside the batch the smallest address wins.
    """
    owners = store.select("id", F.col("normalized_url").alias("owner"), F.lit(0).alias("age"))
    asked = materialise(batch.select("id").distinct(), "asked-ids")
    owners = owners.join(bounded_broadcast(asked), "id", "left_semi")
    fresh = batch.select("id", F.col("normalized_url").alias("owner"), F.lit(1).alias("age"))
    first = owners.unionByName(fresh).groupBy("id").agg(F.min(F.struct("age", "owner")).alias("first"))
    suffix = F.concat(F.lit("_"), F.substring(F.md5("normalized_url"), 1, 8))
    renamed = F.when(F.col("first.owner") == F.col("normalized_url"), F.col("id")).otherwise(F.concat("id", suffix))
    return batch.join(first, "id").withColumn("id", renamed).drop("first")
