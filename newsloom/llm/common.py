"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import materialise, prepare

# fixed values: the white space of all text contracts, [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(docs: DataFrame) -> DataFrame:
    """Ships this package to the workers of the session that owns ``docs``."""
    prepare(docs.sparkSession)
    return docs


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read again: later steps survive lost executors."""
    prepare(df.sparkSession)
    return materialise(df, f"llm-{label}")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text has no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def bucket_of(n: int, *columns: str | Column) -> Column:
    """A bucket from 0 to ``n`` - 1 that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def buckets_for(df: DataFrame) -> int:
    """As many buckets as the session's shuffles have partitions: follows the size of the cluster."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def strings(column: pa.ChunkedArray | pa.Array) -> Iterator[str]:
    """Python strings of an Arrow column, one at a time; null becomes the empty string."""
    for value in column:
        yield value.as_py() or ""


def encoded(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of an Arrow column, one at a time; null becomes no bytes."""
    return map(bytes, views(column))


def views(column: pa.Array) -> Iterator[memoryview]:
    """The same without a copy: views of the buffer of the column."""
    blob = column.cast(pa.large_binary())
    offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    data = memoryview(blob.buffers()[2] or b"")
    valid = np.ones(len(blob), bool) if not blob.null_count else np.asarray(blob.is_valid())
    for i in range(len(blob)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices, so that what a kernel holds beside its input stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kth_largest(scored: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value: counts per bin narrow it down, and at most ``bins`` values are looked at."""
    low, high, n = scored.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return None
    if k >= n:
        return low
    now, above = scored.select(column), 0
    while low < high:
        width = (high - low) / bins
        if not low + width > low:
            break
        number = F.least(F.floor((F.col(column) - low) / width).cast("int"), F.lit(bins - 1))
        binned = now.withColumn("_bin", number)
        for row in sorted(binned.groupBy("_bin").agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r._bin):
            if above + row.n >= k:
                break
            above += row.n
        if row.n <= bins:
            values = [r[0] for r in now.where(F.col(column).between(row.lo, row.hi)).collect()]
            return sorted(values, reverse=True)[k - above - 1]
        low, high = row.lo, row.hi
        now = now.where(F.col(column).between(low, high))
    return low
