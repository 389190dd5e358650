"""Corpus jobs around byte-level BPE: lexicon of frequent words, encoding, decoding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.bpe import Decoder, Transducer, encoder_of, library_of, vocabulary_of, words_of
from newsloom.llm.common import kept_table, kth_largest, pieces, ready, strings

LEXICON_WORDS = 20_000
WORD_BYTES = 64


def vocabulary_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _count_kernel(file, word_bytes: int):
    def counted(texts, vocabulary) -> pa.RecordBatch:
        words, counts = words_of(texts, vocabulary)
        short = pc.less_equal(pc.binary_length(words), word_bytes)
        return pa.RecordBatch.from_arrays([words.filter(short).cast(pa.string()), pa.array(counts).filter(short)], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(file.value)
        texts, size = [], 0
        for batch in pieces(batches):
            for text in strings(batch.column(0)):
                texts.append(text)
                size += len(text)
                if size > 1 << 23:
                    yield counted(texts, vocabulary)
                    texts, size = [], 0
        if texts:
            yield counted(texts, vocabulary)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def word_counts(docs: DataFrame, vocabulary: bytes, text_col: str = "text", word_bytes: int = WORD_BYTES) -> DataFrame:
    """(word, n): pre-tokens of all texts up to ``word_bytes`` long, with their number of occurrences.

    Every task counts before the shuffle, so a very common word is a few rows per task.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(vocabulary)  # the vocabulary file: a fixed size
    partial = ready(docs).select(F.col(text_col)).where(F.col(text_col) != "").mapInArrow(_count_kernel(file, word_bytes), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: bytes, words: int = LEXICON_WORDS, text_col: str = "text") -> bytes:
    """Transducer tables of the at most ``words`` most frequent words of the whole corpus.

    Words that tie with the first one beyond the bound are left out.  The size of the result is bounded by
    ``words`` and WORD_BYTES, whatever the corpus is.
    """
    counts = kept_table(word_counts(docs, vocabulary, text_col), "words")
    if counts.count() > words:
        counts = counts.where(F.col("n") > kth_largest(counts, "n", words + 1))
    merge = vocabulary_of(vocabulary).merge
    return Transducer.compile(sorted((raw, merge(raw)) for raw in (r.word.encode() for r in counts.select("word").collect())))


def portions(batches: Iterable[pa.RecordBatch], text_at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with texts of at most ``size`` bytes, or one row: a word that many of them have is looked up once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right")))
            yield batch.slice(at, to - at)
            at = to


def _encode_kernel(file, tables, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(file.value)
        library = library_of(vocabulary) if tables is None else None
        encoder = None if library else encoder_of(vocabulary, None if tables is None else tables.value)
        for batch in portions(batches, text_at):
            texts = strings(batch.column(text_at))
            packed = list(map(library, texts)) if library else encoder.encode_many(texts)
            kept = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(packed, pa.binary())], names)
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, vocabulary: bytes, lexicon: bytes | None = None, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` (all but the text by default) and ``ids``: packed little-endian 32-bit ids.

    With a ``lexicon`` by its transducer, and exact merges for other words; without one by the installed
    tokenizer library, if the vocabulary is of the kind that it knows.
    Equal to the vocabulary's own tokenizer without added special tokens; a special token's own string in
    a text becomes its id.  A null text is empty and has no ids.  A column named ``ids`` is replaced.
    """
    context = docs.sparkSession.sparkContext
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", text_col)]
    source = ready(docs).select(*keep, text_col)
    schema = ", ".join([*(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep), "ids binary"])
    file = context.broadcast(vocabulary)
    tables = None if lexicon is None else context.broadcast(lexicon)
    return source.mapInArrow(_encode_kernel(file, tables, len(keep), [*keep, "ids"]), schema)


def _decode_kernel(file, ids_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary_of(file.value))
        for batch in pieces(batches, 256):
            texts = [decoder.decode(v.as_py() or b"") for v in batch.column(ids_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return run


def decode(encoded: DataFrame, vocabulary: bytes, ids_col: str = "ids") -> DataFrame:
    """``encoded`` and ``decoded``, the text of the packed ids; null ids are no ids."""
    source = ready(encoded.drop("decoded"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), "decoded string"])
    file = source.sparkSession.sparkContext.broadcast(vocabulary)
    return source.mapInArrow(_decode_kernel(file, source.columns.index(ids_col), [*source.columns, "decoded"]), schema)


def ids_array(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")
