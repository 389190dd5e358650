"""Exact duplicates by composable polynomial fingerprints.

A text without its white space is cut into chunks.  Each chunk has a polynomial hash, and the hash of
two neighbouring parts is ``hash(x) * base ** len(y) + hash(y)``, so chunk hashes combine to the
fingerprint of the whole text in any grouping.  Texts of equal length and fingerprint are then compared
chunk by chunk: per chunk number the smallest and the largest content of the group must be the same
bytes.  Both are aggregates with map-side combine, so a group that holds a third of all rows costs one
row per task and chunk, and no task ever gathers a group.  Groups that fail are split by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import BLANK_BYTES, encoded, kept_table, pieces, ready

CHUNK_BYTES = 1 << 16


@dataclass(frozen=True)
class Polynomial:
    """Hash of a byte string as a polynomial in ``base`` modulo ``prime`` (below 2 ** 31)."""

    base: int
    prime: int

    def powers(self, n: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        value = 1
        for i in range(n):
            out[i] = value
            value = value * self.base % self.prime
        return out

    def of_chunk(self, chunk: np.ndarray, powers: np.ndarray) -> int:
        # 2 ** 16 products below 2 ** 40 stay below 2 ** 64
        return int((chunk[::-1] * powers[: len(chunk)]).sum() % np.uint64(self.prime))

    def combine(self, left: int, right: int, right_length: int) -> int:
        """Fingerprint of left + right from the two parts and the length of the right one."""
        return (left * pow(self.base, right_length, self.prime) + right) % self.prime


POLYNOMIALS = (Polynomial(1_000_003, 2**31 - 1), Polynomial(16_777_619, 2**31 - 19))


def fingerprint(data: bytes, polynomials=POLYNOMIALS, tables=None, chunk_bytes: int = CHUNK_BYTES) -> int:
    """The combined hashes of all chunks, the two residues side by side in one long."""
    tables = tables or [p.powers(chunk_bytes) for p in polynomials]
    whole = np.frombuffer(data, np.uint8)
    totals = [0] * len(polynomials)
    for at in range(0, len(whole), chunk_bytes):
        chunk = whole[at : at + chunk_bytes].astype(np.uint64) + np.uint64(1)
        totals = [
            p.combine(total, p.of_chunk(chunk, powers), len(chunk))
            for p, total, powers in zip(polynomials, totals, tables, strict=True)
        ]
    return (totals[0] << 31) | totals[1]


FINGERPRINTS = "doc_id long, n_chars long, n_bytes long, fp long, text_sha256 string"


def _fingerprint_kernel(polynomials, chunk_bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [p.powers(chunk_bytes) for p in polynomials]
        for batch in pieces(batches):
            sizes, prints, digests = [], [], []
            for raw in encoded(batch.column(1)):
                data = raw.translate(None, BLANK_BYTES)
                sizes.append(len(data))
                prints.append(fingerprint(data, polynomials, tables, chunk_bytes))
                digests.append(hashlib.sha256(data).hexdigest())
            n_chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_chars, pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(digests)],
                ["doc_id", "n_chars", "n_bytes", "fp", "text_sha256"],
            )

    return run


def _chunk_kernel(polynomials, chunk_bytes):
    """Rows (n_bytes, fp, chunk_no, chunk), a few chunks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [p.powers(chunk_bytes) for p in polynomials]
        names = ["n_bytes", "fp", "chunk_no", "chunk"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in pieces(batches, 128):
            rows, held = [], 0
            asked = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), encoded(batch.column(0)), strict=True)
            for n_bytes, fp, raw in asked:
                data = raw.translate(None, BLANK_BYTES)
                if len(data) != n_bytes or fingerprint(data, polynomials, tables, chunk_bytes) != fp:
                    continue  # another text under the same id
                for at in range(0, len(data), chunk_bytes):
                    rows.append((n_bytes, fp, at // chunk_bytes, data[at : at + chunk_bytes]))
                    held += len(rows[-1][3])
                    if held > 64 * chunk_bytes:
                        yield _rows(rows, names, types)
                        rows, held = [], 0
            if rows:
                yield _rows(rows, names, types)

    return run


def _rows(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", polynomials=POLYNOMIALS, chunk_bytes=CHUNK_BYTES) -> DataFrame:
    """One row per document: size, fingerprint and SHA-256 of the text without white space."""
    columns = ready(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return columns.mapInArrow(_fingerprint_kernel(polynomials, chunk_bytes), FINGERPRINTS)


def unequal_groups(docs, prints, id_col="doc_id", text_col="text", polynomials=POLYNOMIALS, chunk_bytes=CHUNK_BYTES) -> DataFrame:
    """(n_bytes, fp) of the groups whose texts differ in some chunk, although their fingerprints agree."""
    shared = prints.groupBy("n_bytes", "fp").count().where("count > 1").select("n_bytes", "fp")
    asked = prints.join(shared, ["n_bytes", "fp"], "left_semi").select("doc_id", "n_bytes", "fp").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(asked, F.col("id").eqNullSafe(F.col("doc_id"))).select("text", "n_bytes", "fp")
    chunks = found.mapInArrow(
        _chunk_kernel(polynomials, chunk_bytes), "n_bytes long, fp long, chunk_no long, chunk binary"
    )
    compared = chunks.groupBy("n_bytes", "fp", "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return compared.where("least <> most").select("n_bytes", "fp").distinct()


def exact_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", polynomials=POLYNOMIALS, chunk_bytes=CHUNK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; of equal texts the one with the most code
    points, then the smallest id stays.  A null text counts as empty.  A null id is a value of its own
    that loses ties.  Repeated rows count in ``group_size``; all rows that carry the kept id are marked
    kept.  An empty table gives an empty result; other columns are not looked at.
    """
    prints = kept_table(fingerprints(docs, id_col, text_col, polynomials, chunk_bytes), "prints")
    unequal = kept_table(unequal_groups(docs, prints, id_col, text_col, polynomials, chunk_bytes), "unequal")
    if unequal.isEmpty():
        classed = prints.withColumn("part", F.lit(""))
    else:
        marked = unequal.withColumn("split", F.lit(True))
        classed = prints.join(marked, ["n_bytes", "fp"], "left").withColumn(
            "part", F.when(F.col("split"), F.col("text_sha256")).otherwise("")
        )
    key = ["n_bytes", "fp", "part"]
    groups = classed.groupBy(*key).agg(
        F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus"))).alias("best"), F.count("*").alias("group_size")
    )
    keep = (-F.col("best.minus")).alias("keep_id")
    return classed.join(groups.select(*key, keep, "group_size"), key).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows stay once."""
    verdicts = exact_duplicates(docs, id_col, text_col).where("kept")
    ids = verdicts.select(F.col("doc_id").alias("_keep")).distinct()
    return (
        docs.join(ids, F.col(id_col).cast("long").eqNullSafe(F.col("_keep")), "left_semi")
        .dropDuplicates([id_col, text_col])
    )
