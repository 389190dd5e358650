"""Approximate nearest vectors by an inverted file.

Spherical k-means on a bounded sample gives cells; every vector is written once, in the folder of its cell.
A query reads the cells whose centres are nearest to it and scores all their vectors exactly.  How many
cells that takes depends on the data, so it is measured: neighbours of a bounded number of stored vectors
are found exactly, and the least number of cells that holds the wanted share of them is kept.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.retrieval import SCORE_DIGITS, top_k, unit_rows
from newsloom.session import materialise

MAX_CELLS = 4_096
SAMPLE_A_CELL = 64
SAMPLE_FLOATS = 1 << 24  # the sample for the centres holds at most this many numbers
KMEANS_ROUNDS = 10
TRIAL_QUERIES = 256
TARGET_RECALL = 0.95
# rows of a cell and queries of a cell that meet in one task
CELL_ROWS = 4_096
CELL_QUERIES = 1_024
SEED = 11


@dataclass(frozen=True)
class Index:
    """A written index: the folder, the centres of the cells, and the cells a query reads."""

    path: str
    centres: np.ndarray
    probes: int

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id string, vector array<float>, cell int").parquet(self.path)


def _nearest_cells(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of every vector, the nearest first; ties to the smaller number."""
    return np.argsort(-np.round(vectors @ centres.T, SCORE_DIGITS), axis=1, kind="stable")[:, :n]


def train_centres(sample: np.ndarray, cells: int, rounds: int = KMEANS_ROUNDS) -> np.ndarray:
    """Spherical k-means; an empty cell keeps its centre."""
    picked = np.random.default_rng(SEED).choice(len(sample), min(cells, len(sample)), replace=False)
    centres = sample[np.sort(picked)]
    for _ in range(rounds):
        cell = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1.0), centres)
    return centres


def _assign(centres: np.ndarray, n: int, key: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = _nearest_cells(unit_rows(batch.column("vector")), centres, n)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                taken = [batch.column(c).take(rows) for c in (key, "vector")]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(cells.reshape(-1), pa.int32())], [key, "vector", "cell"])

    return run


def build_index(
    vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, target: float = TARGET_RECALL, trials: int = TRIAL_QUERIES
) -> Index:
    """Writes ``vectors`` (id, vector) below ``path``, a folder per cell; rows without vector are left out.

    Centres come from a sample by the hash of the id (64 rows a cell, 16 million numbers at most); all
    rows are indexed.  ``cells`` is the square root of the number of rows unless given, at most 4096.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<float>").alias("vector"))
    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    cells = max(1, min(cells or round(n**0.5), MAX_CELLS, max(n, 1)))
    wanted = min(SAMPLE_A_CELL * cells, max(1, SAMPLE_FLOATS // max(1, width or 1)))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * wanted / max(n, 1)) * (1 << 30))
    sample = vectors.where(share).limit(wanted).toArrow() if n else None
    centres = train_centres(unit_rows(sample["vector"].combine_chunks()), cells) if n else np.zeros((1, 1))
    placed = vectors.mapInArrow(_assign(centres, 1, "id"), "id string, vector array<float>, cell int")
    # a large cell is written by several tasks
    spread = max(1, round(n / len(centres) / 100_000))
    dealt = placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(spread)))
    dealt.write.mode("errorifexists").partitionBy("cell").parquet(path)
    index = Index(path, centres, len(centres))
    return replace(index, probes=measured_probes(spark, index, k, target, trials)) if n else index


def measured_probes(spark: SparkSession, index: Index, k: int, target: float, trials: int = TRIAL_QUERIES) -> int:
    """The least number of cells that hold ``target`` of the exact neighbours of ``trials`` stored vectors."""
    stored = index.vectors(spark)
    asked = stored.orderBy(F.xxhash64("id", F.lit(SEED))).limit(trials).select(F.col("id").alias("qid"), "vector")
    asked = materialise(asked, "ann-trials")
    found = search(index, asked, k, probes=len(index.centres)).join(stored.select("id", "cell"), "id")
    own = asked.mapInArrow(_ranked_cells(index.centres), "qid string, order array<int>")
    # at most trials * k rows
    places = found.join(own, "qid").select(F.array_position("order", F.col("cell")).alias("place")).toArrow()["place"].to_numpy()
    counts = np.bincount(places.astype(int), minlength=len(index.centres) + 1)
    return int(np.searchsorted(np.cumsum(counts), target * counts.sum())) if counts.sum() else len(index.centres)


def _ranked_cells(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                order = _nearest_cells(unit_rows(batch.column("vector")), centres, len(centres))
                yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], ["qid", "order"])

    return run


def _best_of_block(k: int):
    def kernel(block: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.string()), "id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        if not block.num_rows or not asked.num_rows:
            return empty
        block = block.sort_by("id")  # of equal scores the smaller ids come first
        scores = np.round(unit_rows(asked["vector"].combine_chunks()) @ unit_rows(block["vector"].combine_chunks()).T, SCORE_DIGITS)
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(best)), best.shape[1])
        return pa.table(
            {
                "qid": asked["qid"].combine_chunks().take(pa.array(rows)),
                "id": block["id"].combine_chunks().take(pa.array(best.reshape(-1))),
                "score": pa.array(np.take_along_axis(scores, best, axis=1).reshape(-1)),
            }
        )

    return kernel


def search(
    index: Index, queries: DataFrame, k: int, probes: int | None = None, cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES
) -> DataFrame:
    """``qid, id, score, rank``: the nearest vectors of ``queries`` (qid, vector) in the probed cells.

    All cells give exact results.  Cells that no query probes are not read.  Rows and queries of a cell
    meet in blocks of bounded size, so neither a large cell nor a popular one is one task.
    """
    spark = queries.sparkSession
    probes = min(probes or index.probes, len(index.centres))
    known = queries.where(F.col("vector").isNotNull()).select("qid", F.col("vector").cast("array<float>").alias("vector"))
    asked = known.mapInArrow(_assign(index.centres, probes, "qid"), "qid string, vector array<float>, cell int")
    asked = materialise(asked, "ann-asked")
    # one row per cell, of which there are at most 4096
    plan = asked.groupBy("cell").agg(F.count("*").alias("n_asked"))
    probed = [r.cell for r in plan.select("cell").collect()]
    if not probed:
        return spark.createDataFrame([], "qid string, id string, score double, rank int")
    stored = index.vectors(spark).where(F.col("cell").isin(probed))
    sizes = stored.groupBy("cell").agg(F.count("*").alias("n_rows"))
    plan = plan.join(sizes, "cell").select(
        "cell", F.ceil(F.col("n_rows") / cell_rows).cast("int").alias("row_parts"), F.ceil(F.col("n_asked") / cell_queries).cast("int").alias("query_parts")
    )
    plan = F.broadcast(materialise(plan, "ann-plan"))

    def parts(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))

    rows = stored.join(plan, "cell").withColumn("row_part", F.pmod(F.xxhash64("id"), F.col("row_parts"))).withColumn("query_part", parts("query_parts"))
    wanted = asked.join(plan, "cell").withColumn("query_part", F.pmod(F.xxhash64("qid"), F.col("query_parts"))).withColumn("row_part", parts("row_parts"))
    key = ("cell", "row_part", "query_part")
    found = (
        rows.select(*key, "id", "vector")
        .groupBy(*key)
        .cogroup(wanted.select(*key, "qid", "vector").groupBy(*key))
        .applyInArrow(_best_of_block(k), "qid string, id string, score double")
    )
    return top_k(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``n_queries, recall``: the share of the exact neighbours that were found."""
    both = exact.select("qid", "id").join(found.select("qid", "id").withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return both.agg(F.countDistinct("qid").alias("n_queries"), (F.count("hit") / F.count("*")).alias("recall"))
