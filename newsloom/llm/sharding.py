"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that must not be split.  Every unit starts as a partial partition (a vector of
shard sizes) with all its bytes in one shard; partial partitions are combined two at a time, always the
two with the largest spread, one in falling and one in rising order of its sizes, until one is left.

The units are a bounded number at every size of the table: each group that holds a fair part of a shard is
a unit, and there can be only so many of these; the groups that are too small for that are bundled by the
hash of their text.  Few enough groups are all units.  Differencing therefore is one small task, its result
is joined to the rows by a broadcast of known size, and no row is shuffled by the hash of its text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import bucket_of, buckets_for, crc32_of, kept_table, ready

OVERHEAD = 16  # fixed value: bytes that every document costs beside its text
BUNDLES = 16_384
DIGEST_BYTES = 32
UNITS_A_SHARD = 256  # a group of more than this part of a mean shard is a unit of its own


def difference(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines the rows of ``sizes`` (partial partitions) to one partition.

    Returns the place of every entry of every row in the result, and the sizes of the result.
    """
    n, k = sizes.shape
    vectors: dict[int, np.ndarray] = {}
    children: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
    heap = []
    for i in range(n):
        vectors[i] = sizes[i]
        heap.append((-int(sizes[i].max() - sizes[i].min()), i))
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        falling = np.argsort(-vectors[a], kind="stable")
        rising = np.argsort(vectors[b], kind="stable")
        vectors[number] = vectors.pop(a)[falling] + vectors.pop(b)[rising]
        # entry falling[j] of a and rising[j] of b share place j
        children[number] = (a, b, falling, rising)
        heapq.heappush(heap, (-int(vectors[number].max() - vectors[number].min()), number))
        number += 1
    root = heap[0][1]
    places = np.empty((n, k), np.int32)
    down = [(root, np.arange(k, dtype=np.int32))]
    while down:
        node, at = down.pop()
        if node < n:
            places[node] = at
            continue
        a, b, falling, rising = children[node]
        for child, order in ((a, falling), (b, rising)):
            mine = np.empty(k, np.int32)
            mine[order] = at
            down.append((child, mine))
    return places, vectors[root]


def divide(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every size, and the sizes of the shards, by differencing.

    Every group starts as a partial partition of its own, with all its bytes in one shard.
    """
    alone = np.zeros((max(1, len(sizes)), shards), np.int64)
    alone[: len(sizes), 0] = sizes
    places, totals = difference(alone)
    return places[: len(sizes), 0], totals


def _divide(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = pa.Table.from_batches(list(batches), pa.schema([("unit", pa.binary()), ("size", pa.int64())]))
        places, _ = divide(units.column("size").to_numpy(), shards)
        for part in units.append_column("shard", pa.array(places, pa.int32())).drop_columns("size").to_batches():
            yield part

    return run


def unit_shards(groups: DataFrame, shards: int, bundles: int = BUNDLES) -> tuple[DataFrame, DataFrame]:
    """Units of ``groups`` (digest, size) and their shards: (digests that are units), (unit, shard).

    The first has at most ``bundles`` or 256 rows a shard, the second at most ``bundles`` more.
    """
    n_groups, total = groups.agg(F.count("*"), F.sum("size")).first()
    fair = 0 if n_groups <= bundles else total / (shards * UNITS_A_SHARD)
    units = groups.select(F.when(F.col("size") > fair, F.col("digest")).otherwise(_bundle(bundles)).alias("unit"), "size")
    units = units.groupBy("unit").agg(F.sum("size").alias("size"))
    # one task for a bounded number of units, in an order that depends on nothing but the texts
    placed = units.repartition(1).sortWithinPartitions("unit").mapInArrow(_divide(shards), "unit binary, shard int")
    placed = kept_table(placed, "units")
    return placed.where(F.length("unit") == DIGEST_BYTES).select(F.col("unit").alias("digest")), placed


def _bundle(bundles: int) -> Column:
    return bucket_of(bundles, "digest").cast("string").cast("binary")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def shard_documents(docs: DataFrame, shards: int = 40, id_col="doc_id", text_col="text", bundles=BUNDLES) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    The size is the UTF-8 length of the text plus 16.  A null text has no bytes and belongs to the group
    of empty texts.  Rows with equal texts get one shard.  Slots run from 0 without gaps in every shard;
    repeated rows get a slot each.  An empty table gives an empty result.
    """
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    n = buckets_for(docs)
    rows = ready(docs).select(
        F.col(id_col).alias("doc_id"), size.alias("size"), crc32_of(text).alias("text_crc32"), _digest(text).alias("digest")
    )
    rows = kept_table(rows.withColumn("bucket", bucket_of(n, "doc_id", "digest")), "sized")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    alone, placed = unit_shards(kept_table(groups, "groups"), shards, bundles)
    # both sides are bounded by parameters
    units = rows.join(F.broadcast(alone.withColumn("_alone", F.lit(True))), "digest", "left")
    units = units.withColumn("unit", F.when(F.col("_alone"), F.col("digest")).otherwise(_bundle(bundles))).drop("_alone")
    placed = units.join(F.broadcast(placed), "unit").drop("unit")
    # slots: every bucket of ids numbers its own rows, then starts after those before it
    order = W.partitionBy("shard", "bucket").orderBy("doc_id", "digest")
    numbered = kept_table(placed.withColumn("_row", F.row_number().over(order) - 1), "numbered")
    counts = numbered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("_row")).cast("long").alias("slot")
    )
