"""Best-two-fit packing of documents into sequences of fixed length.

The packing decides on numbers of documents per length only.  A bin takes the longest document left and
is filled greedily with the longest that fits; then its smallest document gives way to two documents that
fit the gap so opened more tightly.  A filled bin is a pattern and is used as often as its lengths allow.
The histogram has at most one entry per length, however many documents there are, so the plan is made on
the driver in bounded memory; documents then take their places by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import bucket_of, buckets_for, kept_table, pieces, ready
from newsloom.llm.tokenize import encode

CAPACITY = 2048


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, {length: documents}) that use up ``counts`` ({length: documents})."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)  # those with documents left, rising
    plan: list[tuple[int, dict[int, int]]] = []

    def largest(limit: int, used: dict[int, int]) -> int:
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and left[lengths[at]] <= used.get(lengths[at], 0):
            at -= 1
        return lengths[at] if at >= 0 else 0

    while lengths:
        used = {lengths[-1]: 1}
        gap = capacity - lengths[-1]
        while gap and (fit := largest(gap, used)):
            used[fit] = used.get(fit, 0) + 1
            gap -= fit
        if gap:
            smallest = min(used)
            best = (smallest, 0, 0)  # sum, first, second
            used[smallest] -= 1
            room = gap + smallest
            for at in range(bisect_right(lengths, room) - 1, -1, -1):
                first = lengths[at]
                if 2 * first <= best[0]:
                    break
                if left[first] <= used.get(first, 0):
                    continue
                used[first] = used.get(first, 0) + 1
                second = largest(min(first, room - first), used)
                used[first] -= 1
                if second and first + second > best[0]:
                    best = (first + second, first, second)
                    if best[0] == room:
                        break
            for length in best[1:] if best[2] else (smallest,):
                used[length] = used.get(length, 0) + 1
            used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        plan.append((times, used))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                lengths.remove(n)
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, sequence, documents per sequence, offset), sorted by length and rank."""
    rows, sequence, taken = [], 0, {}
    for times, used in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken.get(length, 0), sequence, n, offset))
            taken[length] = taken.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place_kernel(shared, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            within = rank - row[:, 1]
            sequence, at = row[:, 2] + within // row[:, 3], row[:, 4] + within % row[:, 3] * length
            kept = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(at)], names)

    return run


def _cut_kernel(capacity: int, end: bytes, names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            rows = []
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (packed.as_py() or b"") + end
                n = len(data) // 4
                cut = n % capacity or min(n, capacity)
                start = 0
                for piece in range(-(-n // capacity)):
                    rows.append((doc, piece, start, cut, data[4 * start : 4 * (start + cut)]))
                    start, cut = start + cut, capacity
            columns = zip(*rows, strict=True)
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def token_pieces(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, end_id: int = 0, lexicon: bytes | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, piece, start, length, ids) of all documents, each ended by ``end_id``.

    Only a document longer than ``capacity`` is cut; all its pieces but the first are full.
    """
    ids = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), vocabulary, lexicon)
    end = np.array([end_id], "<u4").tobytes()
    schema = f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary"
    return ids.mapInArrow(_cut_kernel(capacity, end, ["doc_id", "piece", "start", "length", "ids"]), schema)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` with sequence_id and offset; ``rows`` has doc_id, piece, length (1 to ``capacity``).

    The offsets of a sequence run from 0 without gaps.  Repeated rows get a place each.
    """
    spark = rows.sparkSession
    n = buckets_for(rows)
    rows = kept_table(rows.drop("sequence_id", "offset").withColumn("bucket", bucket_of(n, "doc_id", "piece")), "pieces")
    order = W.partitionBy("bucket", "length").orderBy("doc_id", "piece")
    numbered = kept_table(rows.withColumn("_row", F.row_number().over(order) - 1), "numbered")
    counts = numbered.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = kept_table(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "starts")
    histogram = starts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    shared = spark.sparkContext.broadcast(places(best_two_fit({r.length: r.n for r in histogram}, capacity)))
    ranked = numbered.join(starts.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("_row"))
    names = [c for c in rows.columns if c != "bucket"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "sequence_id long", "offset long"])
    return ranked.select(*names, "rank").mapInArrow(_place_kernel(shared, [*names, "sequence_id", "offset"]), schema)


def pack_documents(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, with_ids: bool = True, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (if asked for), sequence_id, offset.

    A null text is empty and holds only the end id.  Rows without id are packed too.  An empty table
    gives an empty result.
    """
    cut = token_pieces(ready(docs), vocabulary, capacity, id_col=id_col, text_col=text_col)
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut if with_ids else cut.drop("ids"), capacity)
