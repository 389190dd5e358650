"""Registered queries of this subpackage, one per operator, and their SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table


def _vocabulary() -> bytes:
    import public_tokenizers

    from newsloom.llm.tokenize import vocabulary_file

    return vocabulary_file(public_tokenizers.path("byte_bpe_50k.json"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.importance import importance_sample

    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.pii import KINDS, count_of, personal_data, span_list

    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans")
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.tokenize import build_lexicon, decode, encode

    docs, vocabulary = table(spark, sf_dir, "documents"), _vocabulary()
    lexicon = build_lexicon(docs, vocabulary)
    texts = decode(encode(docs, vocabulary, lexicon, keep=["doc_id"]), vocabulary)
    return texts.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.quality_rules import fit_rules, judge

    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return judge(docs, rules, keep=["doc_id"]).select(*columns)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.sharding import shard_documents

    dealt = shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return dealt.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.url_rules import judge_urls, mine_rules

    pages = table(spark, sf_dir, "pages")
    mined = mine_rules(pages, table(spark, sf_dir, "labels"))
    return judge_urls(pages, mined).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), _vocabulary(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.order_minhash import fingerprint_documents

    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsloom.llm.conversations import damage, repair_audit, repaired_turns

    return repair_audit(repaired_turns(damage(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_jaccard_join,
        op3_url_rules,
        op4_importance_resampling,
        op5_pii,
        op6_bpe,
        op7_exact_dedup,
        op8_packing,
        op9_warc_round_trip,
        op10_quality_rules,
        op11_order_minhash,
        op12_source_divergence,
        op13_conversation_repair,
        pipeline,
    )
}
