"""Importance resampling: documents that look like a target, sampled by Gumbel top-k.

Two generative models of hashed words and word pairs are counted, one over labelled good documents and
one over the whole corpus.  The weight of a document is the log ratio of its probabilities; adding Gumbel
noise and taking the k largest is sampling without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import encoded, kept_table, kth_largest, pieces, ready
from newsloom.llm.jaccard_join import mix, word_hashes

FEATURES = 10_000


def feature_buckets(raw: bytes, features: int = FEATURES) -> np.ndarray:
    """Buckets of all words and word pairs of a text."""
    words = word_hashes(raw)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
    return (np.concatenate((words, pairs)) % np.uint64(features)).astype(np.int64)


def _count_kernel(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features, np.int64)
        for batch in pieces(batches):
            for raw in encoded(batch.column(0)):
                total += np.bincount(feature_buckets(raw, features), minlength=features)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, features: int = FEATURES) -> np.ndarray:
    """Occurrences per bucket over all rows of the one text column; at most ``features`` rows reach the driver."""
    partial = ready(texts).mapInArrow(_count_kernel(features), "bucket int, n long")
    out = np.zeros(features, np.int64)
    for row in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket log p(target) - log p(raw), with one added to every count."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def _score_kernel(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        for batch in pieces(batches):
            scores = [float(ratios[feature_buckets(raw, len(ratios))].sum()) for raw in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "log_ratio"])

    return run


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col="doc_id", text_col="text") -> tuple[DataFrame, float]:
    """Texts of at most ``sample`` labelled good documents (smallest hash of the id), and the share of quality 1.

    Good: quality 1 and not toxic.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_label_id")).agg(
        F.min(good).alias("_good"), F.min(F.col("quality") == 1).alias("_quality")
    )
    share = known.agg(F.avg(F.col("_quality").cast("double"))).first()[0]
    chosen = known.where("_good").orderBy(F.xxhash64("_label_id"), "_label_id").limit(sample).select("_label_id")
    # at most `sample` numbers
    texts = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_label_id"), "left_semi").select(text_col)
    return texts, 1.0 if share is None else share


def importance_sample(
    docs: DataFrame,
    labels: DataFrame,
    fraction: float | None = None,
    seed: int = 42,
    sample: int = 20_000,
    features: int = FEATURES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, log_ratio, gumbel_key, kept.

    ``fraction`` of the rows is kept; by default the share of quality 1 among the labels.  Rows that
    tie with the last one kept stay too, so repeated rows share their fate.  A null text is empty and has
    log ratio 0.  Noise depends on ``seed`` and the id alone.  An empty table gives an empty result;
    without good labels every ratio comes from the corpus alone.
    """
    texts, share = good_documents(docs, labels, sample, id_col, text_col)
    ratios = log_ratios(bucket_counts(texts, features), bucket_counts(docs.select(text_col), features))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    rows = ready(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_score_kernel(shared), "doc_id long, log_ratio double")
    # 52 bits of a hash, never 0 or 1
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored = kept_table(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform))), "importance")
    k = round((share if fraction is None else fraction) * scored.count())
    last = kth_largest(scored, "gumbel_key", k)
    kept = F.lit(False) if last is None else F.col("gumbel_key") >= F.lit(last)
    return scored.withColumn("kept", kept)
