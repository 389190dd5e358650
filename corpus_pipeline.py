"""From raw documents to packed training sequences, in five stages.

Each stage gets all rows that its predecessor kept, as a table written to the shared folder.  All but the
last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import kept_table, table

# names that operators add; a column of the documents with such a name is set aside and comes back
ADDED = ("base", "spans", "base_failed", "rule", "kept")


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    from newsloom.llm.quality_rules import STATISTICS

    columns = docs.columns
    renamed = {c: f"_own_{c}" for c in columns if c in ADDED or c in STATISTICS}
    back = [F.col(renamed.get(c, c)).alias(c) for c in columns]
    return docs.withColumnsRenamed(renamed), lambda out: out.select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a learned rule rejects go."""
    from newsloom.llm.quality_rules import fit_rules, judge

    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    own, back = _aside(docs)
    return back(judge(own, rules).where("kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays."""
    from newsloom.llm.exact_dedup import without_duplicates

    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of texts that share 80 % of their five-word shingles the smallest id stays."""
    from newsloom.llm.jaccard_join import jaccard_components

    groups = jaccard_components(docs, n=5, num=80, den=100)
    stays = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, F.col("doc_id").eqNullSafe(F.col("_stays")), "left_semi")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; all documents stay."""
    from newsloom.llm.pii import personal_data as find
    from newsloom.llm.pii import redacted

    own, back = _aside(docs)
    found = find(own).withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return back(found)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    from newsloom.llm.packing import pack_documents
    from newsloom.llm.tokenize import vocabulary_file

    vocabulary = vocabulary_file(public_tokenizers.path("byte_bpe_50k.json"))
    return pack_documents(docs, vocabulary, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

# learned rules, tries and tokens cannot be written in SQL; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
