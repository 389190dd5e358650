"""The vector index against exact search."""

import re

import numpy as np
import pytest

from newsloom.operators import ann
from newsloom.operators.retrieval import vector_topk
from newsloom.session import scratch_path


def vectors_of(spark, values):
    rows = [(f"a{i:05}", v.tolist() if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, vector array<float>").repartition(5).cache()


def exact(vectors, asked, k):
    return vector_topk(vectors.withColumnRenamed("vector", "title_embedding"), asked.withColumnRenamed("vector", "query_embedding"), k)


def pairs(hits):
    return sorted(tuple(r) for r in hits.select("qid", "rank", "id", "score").collect())


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = np.random.default_rng(1)
    middle = rnd.normal(size=(40, 24))
    values = [middle[rnd.integers(40)] + 0.25 * rnd.normal(size=24) for _ in range(4000)]
    values += [None, np.zeros(24), values[7], values[7], -values[7]]
    return vectors_of(spark, values)


def test_recall_and_pruning(spark, clustered):
    index = ann.build_index(clustered, scratch_path(spark, "test-ann"), cells=64)
    # every row with a vector lies in one cell
    assert index.vectors(spark).select("id").distinct().count() == index.vectors(spark).count() == clustered.where("vector IS NOT NULL").count()
    # clusters: a small part of the cells is enough
    assert index.probes <= 16
    asked = clustered.where("vector IS NOT NULL AND cast(substr(id, 2) as int) % 50 = 0").selectExpr("id AS qid", "vector")
    found = ann.search(index, asked, 10)
    n, share = ann.recall(found, exact(clustered, asked, 10)).first()
    assert n == asked.count() and share >= 0.9
    # hits carry exact scores and the copies of a vector come in order of their ids
    scores = {(r.qid, r.id): r.score for r in exact(clustered, asked, 4005).collect()}
    assert all(scores[r.qid, r.id] == pytest.approx(r.score, abs=1e-9) for r in found.collect())
    one = asked.where("qid = 'a00000'")
    plan = ann.search(index, one, 10, probes=2)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(\d+,\s*\d+\)", plan)


def test_all_cells_are_exact(spark, clustered):
    index = ann.build_index(clustered, scratch_path(spark, "test-ann"), cells=9)
    asked = clustered.where("vector IS NOT NULL AND cast(substr(id, 2) as int) % 400 IN (0, 7)").selectExpr("id AS qid", "vector")
    expected = pairs(exact(clustered, asked, 7))
    assert pairs(ann.search(index, asked, 7, probes=9)) == expected
    # a popular cell meets its queries in many small blocks
    assert pairs(ann.search(index, asked, 7, probes=9, cell_rows=37, cell_queries=2)) == expected


def test_random_vectors_need_many_cells(spark):
    values = np.random.default_rng(3).normal(size=(1500, 32))
    vectors = vectors_of(spark, list(values))
    index = ann.build_index(vectors, scratch_path(spark, "test-ann"))
    asked = vectors.where("cast(substr(id, 2) as int) % 50 = 0").selectExpr("id AS qid", "vector")
    assert ann.recall(ann.search(index, asked, 10), exact(vectors, asked, 10)).first()[1] >= 0.9


def test_no_vectors(spark):
    nothing = spark.createDataFrame([("a", None)], "id string, vector array<float>")
    index = ann.build_index(nothing, scratch_path(spark, "test-ann"))
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", None)], "qid string, vector array<float>")
    assert ann.search(index, asked.where("qid = 'r'"), 5).count() == 0
