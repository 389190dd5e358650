"""Text clauses of a batch of queries, scored where the articles lie.

The words of every article are counted once and written, one row per article.  A batch of queries is
turned into blocks of asked words and n-grams, which are small; tasks take them to the postings.  One pass
counts in how many articles each asked term occurs, a second one scores whole articles against whole
queries.  An article and a query meet in one task with all their terms, so no pair of them is shuffled
before it is among the best of its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import char_ngrams, search_words
from newsloom.session import materialise

# Fixed values of the search: term saturation, field weights.
K1 = 0.25
FIELD_WEIGHTS = {
    "article_title": 1.5,
    "article_text_beginning": 0.1,
    "article_text": 0.1,
    "source_name": 1.0,
    "article_authors": 1.0,
}
FIELDS = tuple(FIELD_WEIGHTS)
WORD_FIELDS = ("article_title", "article_text_beginning", "source_name", "article_authors")
GRAM_SIZES = (2, 3, 4)
QUERY_BLOCK = 512
BLOCKS_A_SCAN = 4  # blocks of queries that one pass over the postings serves
ROWS = 256  # articles scored at a time
KNOWN_WORDS = 1 << 18  # words whose terms a task remembers
CHUNK_ROWS = 2048  # articles whose words are looked up at a time
TABLE_CELLS = 1 << 22  # largest table in place of a search among numbers

POSTINGS = "words array<string>, fields array<int>, places array<int>, counts array<int>"


def _field_words(name: str) -> Column:
    text = F.array_join(F.col(name), ", ") if name == "article_authors" else F.col(name)
    return search_words(text)


def _lists(sizes: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts words by row and field, for a bounded number of rows at a time."""
    kept = len(FIELDS)
    for batch in _slices(batches):
        n = batch.num_rows
        sizes = [pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False) for i in range(kept)]
        coded = pa.concat_arrays([batch.column(i).flatten() for i in range(kept)]).dictionary_encode()
        known = max(1, len(coded.dictionary))
        cell = np.concatenate([np.repeat(np.arange(n, dtype=np.int64) * kept + i, size) for i, size in enumerate(sizes)])
        keys, counts = np.unique(cell * known + coded.indices.to_numpy(), return_counts=True)
        cell, word = np.divmod(keys, known)
        row = cell // kept
        own, place = np.unique(row * known + word, return_inverse=True)
        n_words = np.bincount(own // known, minlength=n)
        place = place - (np.cumsum(n_words) - n_words)[row]
        entries = np.bincount(row, minlength=n)
        made = [_lists(n_words, coded.dictionary.take(pa.array(own % known)))]
        made += [_lists(entries, pa.array(x.astype(np.int32))) for x in (cell % kept, place, counts)]
        names = ["words", "fields", "places", "counts"]
        yield pa.RecordBatch.from_arrays([*batch.columns[kept:], *made], [*batch.schema.names[kept:], *names])


def postings(articles: DataFrame, keep: list[Column] | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``id``, the columns ``keep`` and the counted words of every article in the wanted fields, written once."""
    none = F.array().cast("array<string>")
    words = [(_field_words(name) if name in fields else none).alias(f"_{name}") for name in FIELDS]
    wanted = articles.select(*words, "id", *(keep or []))
    kept = wanted.drop(*[f"_{name}" for name in FIELDS])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return materialise(wanted.mapInArrow(_count_words, f"{types}, {POSTINGS}"), "postings")


@dataclass
class Asked:
    """A block of queries: their terms, numbered, and what else a query brings."""

    qids: list[str] = field(default_factory=list)
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    word_terms: list[np.ndarray] = field(default_factory=list)
    gram_terms: list[np.ndarray] = field(default_factory=list)
    extra: dict[str, list] = field(default_factory=dict)
    df: np.ndarray | None = None
    _trie: tuple | None = None

    @property
    def n_terms(self) -> int:
        return len(self.words) + len(self.grams)

    def trie(self) -> tuple:
        """Look-up of the letters of the n-grams, how many there are, and per length the look-up of nodes by (node
        before, letter) and the n-gram (or -1) that ends at a node.  Letters and nodes of a length are numbered from 1."""
        if self._trie is None:
            letters = sorted({ord(x) for g in self.grams for x in g})
            number = {x: i + 1 for i, x in enumerate(letters)}
            nodes: list[dict[int, int]] = [{} for _ in range(max(GRAM_SIZES) + 1)]
            ends: list[dict[int, int]] = [{} for _ in nodes]
            for gram, term in self.grams.items():
                node = number[ord(gram[0])]
                for size in range(2, len(gram) + 1):
                    key = node * (len(letters) + 1) + number[ord(gram[size - 1])]
                    node = nodes[size].setdefault(key, len(nodes[size]) + 1)
                ends[len(gram)][node] = term
            levels = {}
            for size in GRAM_SIZES:
                keys = np.array(sorted(nodes[size]), np.int64)
                of_node = np.full(len(keys) + 1, -1)
                of_node[list(ends[size])] = list(ends[size].values())
                levels[size] = _numbers(keys, np.array([nodes[size][k] for k in keys.tolist()], np.int64)), of_node
            self._trie = _numbers(np.array(letters, np.int64), np.arange(1, len(letters) + 1)), len(letters), levels
        return self._trie


def asked_blocks(queries: DataFrame, ngrams: bool, extra: list[str] | None = None) -> Iterator[list[Asked]]:
    """Blocks of about 512 queries, a few at a time on the driver.

    Words of a query count once, and so do the n-grams of its words.
    """
    words = F.array_distinct(search_words(F.col("q")))
    grams = F.array_distinct(F.flatten(F.transform(words, lambda w: char_ngrams(w)))) if ngrams else F.array().cast("array<string>")
    known = queries.select("qid", words.alias("words"), grams.alias("grams"), *(extra or []))
    n_blocks = max(1, -(-known.count() // QUERY_BLOCK))
    known = materialise(known.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n_blocks))), "asked-words")
    for start in range(0, n_blocks, BLOCKS_A_SCAN):
        blocks: dict[int, Asked] = {}
        for row in known.where(F.col("block").between(start, start + BLOCKS_A_SCAN - 1)).orderBy("block", "qid").toLocalIterator():
            asked = blocks.setdefault(row["block"], Asked(extra={name: [] for name in extra or []}))
            asked.qids.append(row["qid"])
            asked.word_terms.append(np.array([asked.words.setdefault(w, len(asked.words)) for w in row["words"]], np.int64))
            asked.gram_terms.append(np.array([asked.grams.setdefault(g, len(asked.grams)) for g in row["grams"]], np.int64))
            for name in extra or []:
                asked.extra[name].append(row[name])
        if blocks:
            yield list(blocks.values())


def _numbers(keys: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Looks up the values (from 1) of numbers among the ordered keys; 0 for others.  A table, unless it were large."""
    if len(keys) and keys[-1] < TABLE_CELLS:
        table = np.zeros(keys[-1] + 2, np.int32)
        table[keys] = values
        return lambda wanted: table[np.minimum(wanted, len(table) - 1)]

    def find(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return np.where(keys[at] == wanted, values[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)

    return find


def _term_hits(words: pa.Array, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Asked terms in distinct words, word by word, and where those of each word end.  The whole word comes before
    its n-grams, which count as often as they occur."""
    number = pc.index_in(words, value_set=pa.array(list(asked.words), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    found = [np.flatnonzero(number >= 0)]
    terms = [number[found[0]].astype(np.int64)]
    if asked.grams:
        letters, n_letters, levels = asked.trie()
        text = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        letter = letters(text)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        word, left = np.repeat(np.arange(len(words)), sizes), np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
        here = np.flatnonzero(letter)
        node = letter[here]
        for size in GRAM_SIZES:
            nodes, of_node = levels[size]
            long = left[here] >= size
            here, node = here[long], node[long]
            node = nodes(node.astype(np.int64) * (n_letters + 1) + letter[here + size - 1])
            known = np.flatnonzero(node)
            here, node = here[known], node[known]
            term = of_node[node]
            ended = np.flatnonzero(term >= 0)
            found.append(word[here[ended]])
            terms.append(len(asked.words) + term[ended])
    found, terms = np.concatenate(found), np.concatenate(terms).astype(np.int32)
    return terms[np.argsort(found, kind="stable")], np.cumsum(np.bincount(found, minlength=len(words)))


class _Known:
    """Asked terms in the words that a task met lately, so that a word is searched for them once."""

    def __init__(self, asked: Asked):
        self.asked = asked
        self.forget()

    def forget(self) -> None:
        self.words, self.hits, self.ends = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words; the terms of a word are ``hits[ends[place]:ends[place + 1]]``."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            if len(self.words) + at.null_count > KNOWN_WORDS:
                self.forget()
                at = pc.index_in(words, value_set=self.words)
            new = words.filter(at.is_null())
            hits, ends = _term_hits(new, self.asked)
            self.words = pa.concat_arrays([self.words, new])
            self.ends = np.concatenate((self.ends, self.ends[-1] + ends))
            self.hits = np.concatenate((self.hits, hits))
            at = pc.index_in(words, value_set=self.words)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)


def _known_slices(batches: Iterator[pa.RecordBatch], blocks: list[_Known]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A few articles at a time, and for every block the places of their words."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK_ROWS):
            chunk = batch.slice(start, CHUNK_ROWS)
            coded = chunk.column("words").flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            places = [known.places(coded.dictionary)[codes] for known in blocks]
            offsets = chunk.column("words").offsets.to_numpy()
            for at in range(0, chunk.num_rows, ROWS):
                low, high = offsets[[at, min(at + ROWS, chunk.num_rows)]] - offsets[0]
                yield chunk.slice(at, ROWS), [x[low:high] for x in places]


def _term_keys(batch: pa.RecordBatch, places: np.ndarray, known: _Known, fields: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``(row * number of fields + field) * n_terms + term`` of the asked terms in all counted words of a batch, and
    their counts; n-grams are numbered behind the words.  A key comes once for every word that has the term."""
    asked = known.asked
    sizes = np.diff(batch.column("words").offsets.to_numpy())
    n_entries = np.diff(batch.column("fields").offsets.to_numpy())
    number, place, count = (batch.column(c).flatten().to_numpy() for c in ("fields", "places", "counts"))
    start = np.cumsum(sizes) - sizes
    word = places[np.repeat(start, n_entries) + place]
    begin = known.ends[word]
    many = known.ends[word + 1] - begin
    many[~np.isin(np.arange(len(FIELDS)), [FIELDS.index(f) for f in fields])[number]] = 0
    # whole words do not count in the full text; they are the first hit of a word
    part = np.flatnonzero(~np.isin(np.arange(len(FIELDS)), [FIELDS.index(f) for f in WORD_FIELDS])[number] & (many > 0))
    part = part[known.hits[begin[part]] < len(asked.words)]
    begin[part] += 1
    many[part] -= 1
    # numbers are short where all keys are
    kind = np.int32 if batch.num_rows * len(FIELDS) * max(1, asked.n_terms) < 1 << 31 else np.int64
    cell = ((np.repeat(np.arange(batch.num_rows), n_entries) * len(FIELDS) + number) * max(1, asked.n_terms)).astype(kind)
    upto = np.cumsum(many)
    at = np.arange(upto[-1] if len(upto) else 0)
    at += np.repeat(begin - (upto - many), many)
    keys = np.repeat(cell, many)
    keys += known.hits[at]
    return keys, np.repeat(count, many)


def _term_counts(batch: pa.RecordBatch, places: np.ndarray, known: _Known, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(row, field, term, count) of the asked terms."""
    keys, count = _term_keys(batch, places, known, fields)
    # the counts are sorted behind their keys in one number
    bits = int(count.max(initial=1)).bit_length()
    packed = keys.astype(np.int64)
    packed <<= bits
    packed |= count
    packed.sort()
    keys = packed >> bits
    first = np.concatenate((np.zeros(min(1, len(keys)), np.int64), np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    keys, sums = keys[first], np.add.reduceat(packed & ((1 << bits) - 1), first) if len(first) else first
    cell, term = np.divmod(keys, max(1, known.asked.n_terms))
    return cell // len(FIELDS), cell % len(FIELDS), term, sums


def _count_documents(blocks: list[Asked], fields: tuple[str, ...]):
    def run(batches):
        sums = [np.zeros(len(FIELDS) * asked.n_terms, np.int64) for asked in blocks]
        known = [_Known(asked) for asked in blocks]
        for batch, places in _known_slices(batches, known):
            for i, words in enumerate(known):
                # a row and field counts once for a term
                seen = np.zeros(batch.num_rows * len(sums[i]), np.uint8)
                seen[_term_keys(batch, places[i], words, fields)[0]] = 1
                sums[i] += seen.reshape(batch.num_rows, -1).sum(axis=0, dtype=np.uint16)
        for i, counts in enumerate(sums):
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), i), pa.int32()), pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["block", "cell", "n"]
            )

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def count_documents(stored: DataFrame, blocks: list[Asked], fields: tuple[str, ...]) -> None:
    """Gives every block the number of articles with each asked term, by field."""
    counted = stored.mapInArrow(_count_documents(blocks, fields), "block int, cell long, n long")
    for i, asked in enumerate(blocks):
        asked.df = np.zeros(len(FIELDS) * asked.n_terms)
    # at most one row per field and asked term
    for row in counted.groupBy("block", "cell").agg(F.sum("n").alias("n")).collect():
        blocks[row["block"]].df[row["cell"]] = row["n"]


def clause_scores(batch: pa.RecordBatch, places: np.ndarray, known: _Known, fields: tuple[str, ...], total: int) -> tuple[np.ndarray, ...]:
    """Scores of all articles of a batch for all queries of a block: any word, all words, n-grams (query x article).

    A term scores by its count in a field without length normalisation; a missing match has no score.
    """
    asked = known.asked
    row, number, term, tf = _term_counts(batch, places, known, fields)
    df = asked.df[number * asked.n_terms + term]
    weight = np.array(list(FIELD_WEIGHTS.values()))[number]
    part = weight * np.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1)
    n, shift = batch.num_rows, len(asked.words)
    parts = np.bincount(term * n + row, part, asked.n_terms * n).reshape(asked.n_terms, n)
    any_score, gram_score, found = (np.zeros((len(asked.qids), n)) for _ in range(3))
    for i, (words, grams) in enumerate(zip(asked.word_terms, asked.gram_terms, strict=True)):
        mine = parts[np.asarray(words, np.int64)]
        any_score[i], found[i] = mine.sum(axis=0), (mine > 0).sum(axis=0)
        gram_score[i] = parts[shift + np.asarray(grams, np.int64)].sum(axis=0)
    wanted = np.array([len(w) for w in asked.word_terms])[:, None]
    return any_score, np.where((found == wanted) & (wanted > 0), any_score, 0.0), gram_score


def scan(stored: DataFrame, blocks: list[Asked], fields: tuple[str, ...], kernel: Callable, schema: str, total: int | None = None) -> DataFrame:
    """``kernel(batch, block, scores, state)`` over all batches of articles and blocks of queries.

    The last call of a task has no batch.  ``total`` is the number of articles of the collection.
    """
    total = stored.count() if total is None else total

    def run(batches):
        state: dict = {}
        known = [_Known(asked) for asked in blocks]
        for batch, places in _known_slices(batches, known):
            for words, mine in zip(known, places, strict=True):
                yield from kernel(batch, words.asked, clause_scores(batch, mine, words, fields, total), state)
        yield from kernel(None, None, None, state)

    return stored.mapInArrow(run, schema)
