"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Ties the larger (or the not larger) neighbours of every node to the smallest of its neighbourhood.

    The smallest neighbour comes from an aggregate with map-side combine; the edges of a node with very
    many neighbours are joined back, where AQE may split them.
    """
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("node"))
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("node <> m").select("node", "m"))


def connected(edges: DataFrame, label: str, max_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Rounds of large and small stars until nothing changes; each round is written to the shared folder, so
    a lost executor repeats one round at most.  Self-loops are allowed; an empty table gives an empty one.
    """
    edges = materialise(edges, f"{label}-edges")  # read several times
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        now = materialise(_star(_star(now, True).distinct(), False).distinct(), label)
        mark, before = _fingerprint(now), mark
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy(F.col("a").alias("member")).agg(F.min("b").alias("r"))
    return nodes.join(roots, F.col("node") == F.col("member"), "left").select("node", F.coalesce("r", "node").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them: two numbers for the driver."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
