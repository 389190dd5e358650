"""Text retrieval for a batch of queries: weighted BM25 clauses times ranking factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.functions.boosts import cosine, decay, factor, has_any
from newsloom.operators import postings as P
from newsloom.session import materialise

# Fixed values of the search: tags and factors.
CENTROID_TAGS = ["centroid_k5", "centroid_k10", "centroid_k20", "centroid_k50"]
TAG_BONUS = 1.5
MAX_QUERY_CHARS = 250
RECENCY = {"offset": 48, "rate": 0.5, "scale": 12}
RECENCY_FACTOR = {"const": 2, "weight": 1, "low": 0, "high": 3}
EMBEDDING_FACTOR = {"const": 3, "weight": 1, "low": 0, "high": 5}
SCORE_DIGITS = 9
QUERY_BLOCK = 512


def guard(queries: DataFrame) -> DataFrame:
    """Queries are cut to 250 characters; empty ones ask for nothing."""
    return queries.withColumn("q", F.substring("q", 1, MAX_QUERY_CHARS)).where(F.length("q") > 0)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _matches(batch, asked, scores, state):
    if batch is None:
        return
    any_score, all_score, gram_score = scores
    query, row = np.nonzero(any_score + gram_score)
    if len(query):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(asked.qids, pa.string()).take(pa.array(query)),
                batch.column("id").take(pa.array(row)),
                *(pa.array(x[query, row]) for x in scores),
            ],
            ["qid", "id", "any_score", "all_score", "ngram_score"],
        )


def text_scores(articles: DataFrame, queries: DataFrame, ngrams: bool = True) -> DataFrame:
    """``qid, id, any_score, all_score, ngram_score`` of all articles matching some term.

    ``all_score`` repeats ``any_score`` where every query word occurs.
    """
    fields = P.FIELDS if ngrams else P.WORD_FIELDS
    stored = P.postings(articles, fields=fields)
    schema = "qid string, id string, any_score double, all_score double, ngram_score double"
    found = []
    for blocks in P.asked_blocks(queries, ngrams):
        P.count_documents(stored, blocks, fields)
        found.append(P.scan(stored, blocks, fields, _matches, schema))
    return _union(found) if found else articles.sparkSession.createDataFrame([], schema)


def in_date_range(ts: Column, min_date: Column, max_date: Column) -> Column:
    """Inclusive day range; an empty or missing end is open.

    An end that is no date fails its own query only: nothing is in its range.
    """
    low_text, high_text = F.nullif(min_date, F.lit("")), F.nullif(max_date, F.lit(""))
    low = F.try_to_timestamp(F.concat(low_text, F.lit(" 00:00:00")))
    high = F.try_to_timestamp(F.concat(high_text, F.lit(" 23:59:59")))
    above = F.when(low_text.isNull(), F.lit(True)).otherwise(F.coalesce(ts >= low, F.lit(False)))
    below = F.when(high_text.isNull(), F.lit(True)).otherwise(F.coalesce(ts <= high, F.lit(False)))
    return above & below


def recency_factor(ts: Column, target: Column) -> Column:
    return factor(decay(ts, target, **RECENCY), **RECENCY_FACTOR)


def centrality_factor(score: Column) -> Column:
    return factor(F.coalesce(score, F.lit(0.0)), const=1, weight=2, low=1, high=10)


def embedding_factor(a: Column, b: Column) -> Column:
    return factor(cosine(a, b), **EMBEDDING_FACTOR)


def top_k(hits: DataFrame, limit: int, start: int = 0) -> DataFrame:
    """Best hits per query by score, ties by id.

    The rank filter is pushed below the shuffle, so each partition sends at most
    ``start + limit`` rows per query.
    """
    order = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= start + limit) & (F.col("rank") > start))


def retrieve(
    articles: DataFrame,
    queries: DataFrame,
    as_of,
    limit: int = 500,
    require_centroid: bool = False,
) -> DataFrame:
    """``qid, id, publish_date, score, rank``: top hits of every query.

    A hit must match some text clause; the tag is a bonus unless ``require_centroid``.
    ``queries`` has ``qid, q`` and optionally ``min_date, max_date, target_date,
    query_embedding``.
    """
    queries = guard(queries)
    defaults = {
        "min_date": F.lit(""),
        "max_date": F.lit(""),
        "target_date": F.lit(None).cast("timestamp"),
        "query_embedding": F.lit(None).cast("array<float>"),
    }
    for name, value in defaults.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, value)
    tagged = has_any(F.col("article_centroid_tags"), CENTROID_TAGS)
    attributes = [
        F.unix_micros("publish_date").alias("ts"),
        F.when(tagged, F.lit(TAG_BONUS)).otherwise(0.0).alias("bonus"),
        centrality_factor(F.col("centrality_score_15")).alias("central"),
        F.col("title_embedding").cast("array<double>").alias("vector"),
    ]
    stored = P.postings(articles.where(tagged) if require_centroid else articles, attributes)
    # the document counts of terms are those of all articles
    everything = P.postings(articles) if require_centroid else stored
    asked = queries.select(
        "qid",
        "q",
        *_bounds(F.col("min_date"), F.col("max_date")),
        F.unix_micros(F.coalesce("target_date", F.lit(as_of).cast("timestamp"))).alias("target"),
        F.col("query_embedding").cast("array<double>").alias("vector"),
    )
    found = []
    total = everything.count()
    for blocks in P.asked_blocks(asked, True, ["low", "high", "target", "vector"]):
        P.count_documents(everything, blocks, P.FIELDS)
        found.append(P.scan(stored, blocks, P.FIELDS, _best_hits(limit), "qid string, id string, publish_date timestamp, score double", total))
    if not found:
        return articles.sparkSession.createDataFrame([], "qid string, id string, publish_date timestamp, score double, rank int")
    return top_k(_union(found), limit)


def _bounds(min_date: Column, max_date: Column) -> list[Column]:
    """First and last microsecond of the days of a query; null is open, a bad date leaves nothing."""
    low_text, high_text = F.nullif(min_date, F.lit("")), F.nullif(max_date, F.lit(""))
    low = F.unix_micros(F.try_to_timestamp(F.concat(low_text, F.lit(" 00:00:00"))))
    high = F.unix_micros(F.try_to_timestamp(F.concat(high_text, F.lit(" 23:59:59"))))
    never = (1 << 63) - 1
    return [
        F.when(low_text.isNotNull(), F.coalesce(low, F.lit(never))).alias("low"),
        F.when(high_text.isNotNull(), F.coalesce(high, F.lit(-never))).alias("high"),
    ]


def _clamped(boost: np.ndarray, const: float, weight: float, low: float, high: float) -> np.ndarray:
    return np.clip(const + weight * boost, low, high)


def _cosines(asked: list, column) -> np.ndarray:
    """Cosines (query x article); missing and zero vectors compare as 0."""
    rows = [x for x in asked if x is not None]
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(asked), len(column)))
    if rows and lengths.max(initial=0):
        some = np.flatnonzero(lengths)
        mine = unit_rows(column.take(pa.array(some)))
        theirs = np.array(rows, float)
        size = np.linalg.norm(theirs, axis=1, keepdims=True)
        given = [i for i, x in enumerate(asked) if x is not None]
        out[np.ix_(given, some)] = (theirs / np.where(size > 0, size, 1.0)) @ mine.T
    return out


class _Best:
    """The best ``k`` hits of every query of a block, by score and id.

    New hits wait until there are enough of them to be sorted in.
    """

    def __init__(self, asked, k: int):
        self.qids, self.k = asked.qids, k
        self.target = np.array(asked.extra["target"], np.int64)[:, None]
        # ends of the wanted time, and which queries have them
        self.ends = [
            (compare, np.array([x is None for x in asked.extra[name]])[:, None], np.array([x or 0 for x in asked.extra[name]], np.int64)[:, None])
            for name, compare in (("low", np.greater_equal), ("high", np.less_equal))
        ]
        self.best = [(np.empty(0), np.empty(0, object), np.empty(0, np.int64))] * len(self.qids)
        self.waiting: list[list[tuple]] = [[] for _ in self.qids]
        self.n = np.zeros(len(self.qids), np.int64)
        self.lowest = np.full(len(self.qids), -np.inf)

    def add(self, hit: np.ndarray, value: np.ndarray, ids: np.ndarray, moments: np.ndarray) -> None:
        hit &= value >= self.lowest[:, None]
        counts = hit.sum(axis=1)
        for i in np.flatnonzero(counts):
            rows = np.flatnonzero(hit[i])
            self.waiting[i].append((value[i, rows], ids[rows], moments[rows]))
        self.n += counts
        for i in np.flatnonzero(self.n > self.k):
            self.sort_in(i)

    def sort_in(self, i: int) -> None:
        found = [np.concatenate(x) for x in zip(self.best[i], *self.waiting[i], strict=True)]
        order = np.lexsort((found[1].astype(str), -found[0]))[: self.k]
        self.best[i], self.waiting[i], self.n[i] = tuple(x[order] for x in found), [], 0
        if len(order) >= self.k:
            self.lowest[i] = self.best[i][0][-1]

    def rows(self):
        for i in np.flatnonzero(self.n):
            self.sort_in(i)
        for start in range(0, len(self.qids), 64):
            part = self.best[start : start + 64]
            names = [q for q, b in zip(self.qids[start : start + 64], part, strict=True) for _ in b[0]]
            columns = [np.concatenate([b[i] for b in part]) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(columns[1], pa.string()), _timestamps(columns[2]), pa.array(columns[0].astype(float))],
                ["qid", "id", "publish_date", "score"],
            )


def _best_hits(k: int):
    """The best ``k`` hits of every query among the articles of a task, by score and id."""

    def kernel(batch, asked, scores, state):
        if batch is None:
            for best in state.values():
                yield from best.rows()
            return
        best = state.get(asked.qids[0])
        if best is None:
            best = state[asked.qids[0]] = _Best(asked, k)
        text = scores[0] + scores[1] + scores[2]
        dated = batch.column("ts").is_valid().to_numpy(zero_copy_only=False)
        ts = batch.column("ts").fill_null(0).to_numpy()
        late = np.maximum(0.0, np.abs(best.target - ts) / 3.6e9 - RECENCY["offset"])
        recent = np.where(dated, np.exp(np.log(RECENCY["rate"]) / RECENCY["scale"] * late), 0.0)
        value = (
            (text + batch.column("bonus").to_numpy())
            * _clamped(recent, **RECENCY_FACTOR)
            * batch.column("central").to_numpy()
            * _clamped(_cosines(asked.extra["vector"], batch.column("vector")), **EMBEDDING_FACTOR)
        )
        value = np.round(value, SCORE_DIGITS)
        hit = scores[0] + scores[2] > 0
        for compare, open_, end in best.ends:
            hit &= open_ | (dated & compare(ts, end))
        best.add(hit, value, np.array(batch.column("id").to_pylist(), object), np.where(dated, ts, NO_TIME))

    return kernel


NO_TIME = -(1 << 63)


def _timestamps(micros: np.ndarray) -> pa.Array:
    return pa.array(micros.astype(np.int64), pa.int64(), mask=micros == NO_TIME).cast(pa.timestamp("us", "UTC"))


def unit_rows(column) -> np.ndarray:
    """Rows of an Arrow list column as vectors of length one."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    matrix = values.reshape(len(column), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1.0)


def _nearest_kernel(shared, k: int):
    """The k best articles of a partition for every query of the block; ties go to the smaller id."""

    def run(batches):
        qids, asked = shared.value
        best = [(np.empty(0), np.empty(0, object)) for _ in qids]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column("id").to_pylist(), object)
            scores = np.round(asked @ unit_rows(batch.column("vector")).T, SCORE_DIGITS)
            for i, mine in enumerate(scores):
                near = np.arange(len(mine))
                if len(mine) > k:
                    near = np.flatnonzero(mine >= np.partition(mine, -k)[-k])
                found, names = np.concatenate((best[i][0], mine[near])), np.concatenate((best[i][1], ids[near]))
                first = np.lexsort((names.astype(str), -found))[:k]
                best[i] = found[first], names[first]
        for start in range(0, len(qids), QUERY_BLOCK):
            part = range(start, min(start + QUERY_BLOCK, len(qids)))
            counts = [len(best[i][0]) for i in part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q for i, n in zip(part, counts, strict=True) for q in [qids[i]] * n], pa.string()),
                    pa.array([x for i in part for x in best[i][1]], pa.string()),
                    pa.array(np.concatenate([best[i][0] for i in part]), pa.float64()),
                ],
                ["qid", "id", "score"],
            )

    return run


def vector_topk(articles: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact nearest titles by cosine: ``qid, id, score, rank``.

    Query vectors are shared in blocks of at most ``block``; the articles stay where they lie, and a
    partition sends on k rows per query.
    """
    context = articles.sparkSession.sparkContext
    wanted = queries.where(F.col("query_embedding").isNotNull()).select("qid", F.col("query_embedding").alias("vector"))
    vectors = articles.where(F.col("title_embedding").isNotNull()).select("id", F.col("title_embedding").alias("vector"))
    n_blocks = max(1, -(-wanted.count() // block))
    ranked = wanted.withColumn("at", F.row_number().over(W.partitionBy(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).alias("b")).orderBy("qid")))
    ranked = ranked.withColumns({"b": F.pmod(F.xxhash64("qid"), F.lit(n_blocks)), "part": F.floor((F.col("at") - 1) / block)})
    ranked = materialise(ranked, "query-vectors")
    best = None
    # a hash part has about `block` queries; larger ones are cut again
    for row in ranked.select("b", "part").distinct().orderBy("b", "part").collect():
        asked = ranked.where((F.col("b") == row["b"]) & (F.col("part") == row["part"])).select("qid", "vector").toArrow()
        shared = context.broadcast((asked["qid"].to_pylist(), unit_rows(asked["vector"].combine_chunks())))
        found = vectors.mapInArrow(_nearest_kernel(shared, k), "qid string, id string, score double")
        best = found if best is None else best.unionByName(found)
    if best is None:
        best = articles.sparkSession.createDataFrame([], "qid string, id string, score double")
    return top_k(best, k)
