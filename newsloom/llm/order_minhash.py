"""Order MinHash: fingerprints of texts that follow edit distance.

The k-mers of a text (runs of eight characters) are numbered by occurrence, so that a repeated k-mer counts
as often as it occurs.  Each of 64 permutations selects the two k-mers of least rank; these are put back
in the order in which the text has them, and the hash of that tuple is one entry of the fingerprint.  Two
texts share an entry only when they agree in k-mers and in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import encoded, kept_table, ready

K = 8
TUPLE = 2
PERMUTATIONS = 64
SEED = 20_240_229
BLOCK_CHARS = 1 << 20
CLASS_KMERS = 1 << 21
CHUNK = 2_048
EXPECTED_HITS = 10

_rng = np.random.default_rng(SEED)
XORS = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
FACTORS = _rng.integers(0, 1 << 32, PERMUTATIONS, np.uint32) | np.uint32(1)
POLYNOMIAL = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmer_hashes(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` characters; a shorter text is one run, an empty one none."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(codes):
        return codes
    k = min(k, len(codes))
    hashes, width, factor = codes + np.uint64(1), 1, POLYNOMIAL
    out, at = None, 0  # polynomial of the first ``at`` characters of every run
    while True:
        if k & width:
            out = hashes if out is None else out[: len(hashes) - at] * np.uint64(factor) + hashes[at:][: len(out)]
            at += width
        if at == k:
            return mixed(out[: len(codes) - k + 1])
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes in which every occurrence of a k-mer after its first differs from the ones before."""
    n = len(hashes)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    places = np.sort((hashes >> bits << bits) | np.arange(n, dtype=np.uint64))
    key = places >> bits
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    if not len(again):
        return hashes
    starts = np.arange(n)
    starts[again] = 0
    number = again - np.maximum.accumulate(starts)[again]
    at = (places[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = hashes.copy()
    out[at] = mixed(hashes[at] + number.astype(np.uint64) * np.uint64(POLYNOMIAL))
    return out


def _classes(text: str, k: int, class_kmers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and positions of the k-mers of a text, by classes of hashes so large that memory holds one."""
    n = max(1, len(text) - k + 1)
    classes = -(-n // class_kmers)
    if classes == 1:
        hashes = kmer_hashes(text, k)
        yield hashes, np.arange(len(hashes))
        return
    for c in range(classes):
        found, places = [], []
        for at in range(0, n, BLOCK_CHARS):
            hashes = kmer_hashes(text[at : min(at + BLOCK_CHARS, n) + k - 1], k)
            mine = np.flatnonzero(hashes % np.uint64(classes) == c)
            found.append(hashes[mine])
            places.append(mine + at)
        yield np.concatenate(found), np.concatenate(places)


def _least(ranks: np.ndarray, limit: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(permutation, place, value) of all values up to ``limit``."""
    rows, cols, values = [], [], []
    limit = np.uint32(min(limit, (1 << 32) - 1))
    room, flags = np.empty(PERMUTATIONS * min(n, CHUNK), np.uint32), np.empty(PERMUTATIONS * min(n, CHUNK), bool)
    for at in range(0, n, CHUNK):
        part = ranks[at : at + CHUNK]
        width = len(part)
        table = room[: PERMUTATIONS * width].reshape(PERMUTATIONS, width)
        np.bitwise_xor(part[None, :], XORS[:, None], out=table)
        np.multiply(table, FACTORS[:, None], out=table)
        flat = room[: PERMUTATIONS * width]
        hits = np.flatnonzero(np.less_equal(flat, limit, out=flags[: PERMUTATIONS * width]))
        rows.append(hits // width)
        cols.append(hits % width + at)
        values.append(flat[hits])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def order_minhash(text: str, k: int = K, class_kmers: int = CLASS_KMERS) -> np.ndarray:
    """The fingerprint: 64 hashes of 16 bits.  Memory beside the text is bounded by ``class_kmers``."""
    rows = np.empty(0, np.int64)
    values, places, kmers = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.uint64)
    for hashes, at in _classes(text, k, class_kmers):
        n = len(hashes)
        if not n:
            continue
        ranks = (numbered(hashes) >> np.uint64(32)).astype(np.uint32)
        limit = (EXPECTED_HITS << 32) // n
        while True:
            row, col, value = _least(ranks, limit, n)
            if limit >= (1 << 32) - 1 or np.bincount(row, minlength=PERMUTATIONS).min() >= TUPLE:
                break
            limit *= 8
        rows, values = np.concatenate([rows, row]), np.concatenate([values, value])
        places, kmers = np.concatenate([places, at[col]]), np.concatenate([kmers, hashes[col]])
        # hits of a permutation come in order of their place, so a stable sort leaves the first of equal values first
        order = np.argsort((rows.astype(np.uint64) << np.uint64(32)) | values, kind="stable")
        first = np.searchsorted(rows[order], np.arange(PERMUTATIONS))
        best = order[np.arange(len(order)) - first[rows[order]] < TUPLE]
        rows, values, places, kmers = rows[best], values[best], places[best], kmers[best]
    out = np.zeros(PERMUTATIONS, np.uint64)
    order = np.lexsort((places, rows))
    rows, kmers = rows[order], kmers[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    for i in range(TUPLE):
        out[rows[nth == i]] = mixed(out[rows[nth == i]] * np.uint64(POLYNOMIAL) + kmers[nth == i] + np.uint64(1))
    return (out >> np.uint64(48)).astype(np.uint16)


def edited_text(text: str, following: str) -> str:
    """The last third replaced by the beginning of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


PRINT_COLUMNS = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _results(batch_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    types = [batch_type, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "border", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _result(doc_id, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    changed = order_minhash(edited) if edited != text else own
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes(), changed.tobytes(),
        float(np.mean(own == changed)), float(np.mean(own == its)),
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of sorted documents; the first and the last of the part come with their texts."""
    task = TaskContext.get()
    part, held, kind = task.partitionId() if task else 0, None, None
    rows = []
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for doc_id, data in zip(batch.column(0).to_pylist(), encoded(batch.column(1)), strict=True):
            text = data.decode()
            own = order_minhash(text)
            if held is None:
                rows.append((doc_id, None, None, own.tobytes(), None, None, None, part, 1, data))
            else:
                rows.append((*_result(*held, text, own), part, 0, None))
            held = (doc_id, text, own)
            if len(rows) >= 1024:
                yield _results(kind, rows)
                rows = []
    if held is not None:
        rows.append((held[0], None, None, held[2].tobytes(), None, None, None, part, 2, held[1].encode()))
        yield _results(kind, rows)


def _over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, own, following, its in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            done = _result(doc_id, text.decode(), np.frombuffer(own, np.uint16), following.decode(), np.frombuffer(its, np.uint16))
            yield _results(batch.schema.field("doc_id").type, [(*done, 0, 0, None)])


def fingerprint_documents(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, both fingerprints (binary), near_edited, near_next.

    The next document is the one that follows by falling id, after the last one the first; a table of one
    row follows itself.  A null id comes last; rows of one id follow each other by the hash of their text.
    A null text is empty; all empty texts have one fingerprint.  A text of fewer than eight characters is
    one k-mer.  Further columns are not read.

    Texts are shuffled once, by ranges of ids, and each meets its successor as the next row of its part;
    equal rows are spread by their place in the input.  Only the texts at the borders of parts move again.
    """
    known = ready(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = known.withColumns({"_tie": F.xxhash64("text"), "_place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie"), F.col("_place")]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    columns = PRINT_COLUMNS.format(id=docs.schema[id_col].dataType.simpleString())
    done = kept_table(dealt.mapInArrow(_neighbours, f"{columns}, part int, border int, text binary"), "fingerprints")
    # one row per part: at most as many as the shuffle has partitions
    first = done.where("border = 1").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("its"))
    after, begin = F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())
    steps = first.select("part", F.coalesce(after, begin).alias("next_part"))
    last = done.where("border = 2").join(F.broadcast(steps), "part")
    pairs = last.join(first.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "fingerprint", "following", "its")
    ends = pairs.mapInArrow(_over_borders, f"{columns}, part int, border int, text binary")
    return done.where("border = 0").unionByName(ends).drop("part", "border", "text")
