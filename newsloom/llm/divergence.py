"""How the sources of a language differ in their words, by single-pass in-memory indexing.

Every task builds postings (term -> count per source) in memory; a full block leaves as a run of segments,
sorted by term and dealt by hash shard.  A shard opens its segments in order of their first term and merges
the open ones by a heap, so that it holds a few segments of every run at a time; terms in enough documents
become frequencies.

A pair of sources is compared over all kept terms of the language without visiting them all: terms that a
source lacks have one common probability there, so the sum follows from the histogram of the other source.
Only terms that both have need a correction; these are streamed into tiles of bounded size.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import bucket_of, buckets_for, encoded, kept_table, ready
from newsloom.session import bounded_broadcast

# fixed values: other bytes than letters and those of non-ASCII characters part terms, only A-Z are lower-cased
PARTS = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
TO_TERMS = bytes(32 if PARTS.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))
SCALE, PRIOR, MIN_DOCS, TOP_TERMS = 1_000_000_000, 5, 30, 50
BLOCK_ENTRIES = 400_000
SLICE_BYTES = 1 << 22
SEGMENT_TERMS = 4_096
SHARDS_A_TASK = 4  # so that tasks get about the same number of shards
TILE = 512
TILES_HELD = 64
BLOCK_SOURCES = 2_048

SEGMENTS = "shard int, lang string, first binary, terms binary, tag long, docs binary, widths binary, places binary, counts binary, sources array<string>"
FREQUENCIES = "lang string, term string, docs long, sources array<string>, counts array<long>"
PAIRS = "lang string, lo string, hi string, value long"


def terms_of(data: bytes, slice_bytes: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Terms of a text, as one list per slice; a slice ends where a term ends."""
    at = 0
    while at < len(data):
        cut = PARTS.search(data, at + slice_bytes) if at + slice_bytes < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end].translate(TO_TERMS).split()
        at = end


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in list(kinds.items())}
    fields = [f.split(" ") for f in ddl.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


class _Block:
    """Postings in memory, until they are taken as a run."""

    def __init__(self, shards: int):
        self.shards = shards
        self.clear()

    def clear(self) -> None:
        self.counts: dict[str, dict[str, Counter]] = {}
        self.docs: dict[str, Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, words: list[bytes]) -> None:
        held = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before = len(held)
        held.update(words)
        self.entries += len(held) - before

    def seen(self, lang: str, words: set[bytes], documents: int) -> None:
        held = self.docs.setdefault(lang, Counter())
        before = len(held)
        held.update(words if documents else dict.fromkeys(words, 0))
        self.entries += len(held) - before

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block as term-sorted segments; then it is empty."""
        for lang, docs in self.docs.items():
            if not docs:
                continue
            counts = self.counts[lang]
            words, sources = sorted(docs), sorted(counts)
            place = dict(zip(words, range(len(words)), strict=True))
            terms = [np.fromiter(map(place.__getitem__, counts[s]), np.int64, len(counts[s])) for s in sources]
            number = [np.fromiter(counts[s].values(), np.int64, len(counts[s])) for s in sources]
            of = np.repeat(np.arange(len(sources)), [len(t) for t in terms])
            in_docs = np.fromiter(map(docs.__getitem__, words), np.int64, len(words))
            yield from segments(lang, sources, words, in_docs, (np.concatenate(terms), of, np.concatenate(number)), 0, self.shards)
        self.clear()


def segments(lang: str, sources: list[str], words: list[bytes], docs: np.ndarray, postings: tuple, tag: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Segments of sorted terms with their numbers of documents, dealt by the hash of the term.

    ``postings`` are three arrays: place of the term, place of the source, count.
    """
    if not words:
        return
    shard = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % shards
    order = np.argsort(shard, kind="stable")  # by shard, then by term
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    by = np.lexsort((postings[1], place[postings[0]]))
    at, of, counts = place[postings[0]][by], postings[1][by], postings[2][by]
    begins = np.flatnonzero(np.diff(shard[order], prepend=-1))
    cuts = [c for x, y in zip(begins, [*begins[1:], len(words)], strict=True) for c in range(x, y, SEGMENT_TERMS)]
    rows = []
    for x, y in zip(cuts, [*cuts[1:], len(words)], strict=True):
        some = order[x:y]
        i, j = np.searchsorted(at, (x, y))
        used, places = np.unique(of[i:j], return_inverse=True)
        widths = np.bincount(at[i:j] - x, minlength=y - x)
        part = [words[w] for w in some.tolist()]
        rows.append((
            int(shard[some[0]]), lang, part[0], b" ".join(part), tag, docs[some].tobytes(), widths.astype(np.int32).tobytes(),
            places.astype(np.int32).tobytes(), counts[i:j].tobytes(), [sources[u] for u in used.tolist()],
        ))
        if len(rows) >= 64:
            yield _batch(SEGMENTS, rows)
            rows = []
    if rows:
        yield _batch(SEGMENTS, rows)


def _tagged(lang: str, words: set[bytes], tag: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Terms of a part of a document: each counts one document, whose tag says which."""
    none = np.empty(0, np.int64)
    return segments(lang, [], sorted(words), np.ones(len(words), np.int64), (none, none, none), tag, shards)


def _index(shards: int, block_entries: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row = _Block(shards), 0
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 40
        for batch in batches:
            for lang, source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2)), strict=True):
                row += 1
                seen, parted = set(), False
                for words in terms_of(data, slice_bytes):
                    block.add(lang, source, words)
                    seen.update(words)
                    if len(seen) > block_entries or block.entries > 2 * block_entries:
                        # a document with very many terms is counted by its tag when runs are merged
                        yield from _tagged(lang, seen, base + row, shards)
                        block.seen(lang, seen, 0)
                        seen, parted = set(), True
                        yield from block.run()
                if parted:
                    yield from _tagged(lang, seen, base + row, shards)
                block.seen(lang, seen, 0 if parted else 1)
                if block.entries > block_entries:
                    yield from block.run()
        yield from block.run()

    return run


class _Segment:
    """A segment that is being merged."""

    __slots__ = ("terms", "docs", "ends", "places", "counts", "sources")

    def __init__(self, row: tuple):
        _, _, _, terms, _, docs, widths, places, counts, self.sources = row
        self.terms, self.docs = terms.split(b" "), np.frombuffer(docs, np.int64).tolist()
        self.ends = np.cumsum(np.frombuffer(widths, np.int32))
        self.places, self.counts = np.frombuffer(places, np.int32), np.frombuffer(counts, np.int64)

    def postings(self, at: int) -> Iterator[tuple[str, int]]:
        part = slice(self.ends[at - 1] if at else 0, self.ends[at])
        return zip([self.sources[p] for p in self.places[part].tolist()], self.counts[part].tolist(), strict=True)


def merged(rows: Iterator[tuple], min_docs: int = 1) -> Iterator[tuple]:
    """(lang, term, documents, {source: count}) of terms in at least ``min_docs`` documents.

    ``rows`` are segments sorted by shard, language and first term.
    """
    heap, part, number = [], None, 0

    def drained(limit: bytes | None):
        while heap and (limit is None or heap[0][0] < limit):
            word, total, last, found = heap[0][0], 0, 0, []
            while heap and heap[0][0] == word:
                _, tag, place, at, segment = heap[0]
                # entries of one document have one tag and follow each other
                if tag == 0 or tag != last:
                    total += segment.docs[at]
                last = tag
                found.append((segment, at))
                if at + 1 < len(segment.terms):
                    heapq.heapreplace(heap, (segment.terms[at + 1], tag, place, at + 1, segment))
                else:
                    heapq.heappop(heap)
            if total >= min_docs:
                sums: dict[str, int] = {}
                for segment, at in found:
                    for source, n in segment.postings(at):
                        sums[source] = sums.get(source, 0) + n
                yield part[1], word, total, sums

    for row in rows:
        if part != row[:2]:
            yield from drained(None)
            part = row[:2]
        yield from drained(row[2])
        number += 1
        heapq.heappush(heap, (row[2], row[4], number, 0, _Segment(row)))
    yield from drained(None)


def _merge(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in batch.columns)

        out = []
        for lang, word, docs, sums in merged(rows(), min_docs):
            out.append((lang, word.decode(), docs, list(sums), list(sums.values())))
            if len(out) >= 2048:
                yield _batch(FREQUENCIES, out)
                out = []
        if out:
            yield _batch(FREQUENCIES, out)

    return run


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")


def term_frequencies(docs: DataFrame, min_docs=MIN_DOCS, block_entries=BLOCK_ENTRIES, slice_bytes=SLICE_BYTES) -> DataFrame:
    """(lang, term, docs, sources, counts) of every term in at least ``min_docs`` documents of its language.

    Null text, lang and source read as empty.  Repeated rows are documents of their own.
    """
    tasks = buckets_for(docs)
    shards = SHARDS_A_TASK * tasks
    runs = ready(_filled(docs)).mapInArrow(_index(shards, block_entries, slice_bytes), SEGMENTS)
    dealt = runs.repartition(tasks, "shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(_merge(min_docs), FREQUENCIES)


def _share(count: Column | str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact: long division of decimals."""
    upper = (F.col(count) if isinstance(count, str) else count) + PRIOR
    scaled = upper.cast("decimal(18,0)") * F.lit(SCALE).cast("decimal(10,0)")
    lower = (F.col(total) + PRIOR * F.col(kept)).cast("decimal(19,0)")
    # a remainder is exact where a quotient would be rounded
    return (F.lit(1) + ((scaled - scaled % lower) / lower).cast("long")).cast("long")


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of what the sources of a term have too much in the sums without common terms."""
    places: dict[str, dict[str, int]] = {}
    names: dict[str, list[str]] = {}
    tiles: dict[tuple, np.ndarray] = {}

    def flushed():
        for (lang, a, b), sums in tiles.items():
            known = names[lang]
            i, j = np.nonzero(np.triu(sums, 1) if a == b else sums)
            for at in range(0, len(i), 65_536):
                some = slice(at, at + 65_536)
                pairs = [sorted((known[a * TILE + x], known[b * TILE + y])) for x, y in zip(i[some], j[some], strict=True)]
                yield _batch(PAIRS, [(lang, lo, hi, v) for (lo, hi), v in zip(pairs, sums[i[some], j[some]].tolist(), strict=True)])
        tiles.clear()

    for batch in batches:
        postings = batch.column(1)
        flat = postings.flatten()
        ends = np.cumsum(pc.list_value_length(postings).to_numpy(zero_copy_only=False))
        coded = pc.dictionary_encode(flat.field("source"))
        codes, spelled = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        shares, absent = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
        begin = 0
        for lang, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
            known, listed = places.setdefault(lang, {}), names.setdefault(lang, [])
            some, begin = slice(begin, end), end
            place = np.empty(end - some.start, np.int64)
            for x, code in enumerate(codes[some].tolist()):
                source = spelled[code]
                if source not in known:
                    known[source] = len(listed)
                    listed.append(source)
                place[x] = known[source]
            order = np.argsort(place)
            place, p, none = place[order], shares[some][order], absent[some][order]
            block = place // TILE
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(place)]
            spans = list(zip(cuts, cuts[1:], strict=False))
            for x, (i, j) in enumerate(spans):
                for k, m in spans[x:]:
                    a, b = p[i:j, None], p[None, k:m]
                    a0, b0 = none[i:j, None], none[None, k:m]
                    extra = abs(a - b) - abs(a - b0) - abs(a0 - b) + abs(a0 - b0)
                    key = (lang, int(block[i]), int(block[k]))
                    if key not in tiles:
                        if len(tiles) >= TILES_HELD:
                            yield from flushed()
                        tiles[key] = np.zeros((TILE, TILE), np.int64)
                    tiles[key][place[i:j, None] % TILE, place[None, k:m] % TILE] += extra
    yield from flushed()


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| of a source against sources that have none of its terms, q their share of absent terms."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for lang, source, p0, kept, hist, others in zip(*columns, strict=True):
            out = [(o["source"], o["p0"]) for o in others if o["source"] != source]
            if not out:
                continue
            sums = np.zeros(len(out), np.int64)
            if kept:
                q = np.array([x for _, x in out], np.int64)
                entries = sorted((h["p"], h["n"]) for h in hist or [])
                p, n = np.array([e[0] for e in entries], np.int64), np.array([e[1] for e in entries], np.int64)
                below = np.searchsorted(p, q)
                number, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * p)])
                present = q * number[below] - mass[below] + (mass[-1] - mass[below]) - q * (number[-1] - number[below])
                sums = present - number[-1] * abs(q - p0)
                # terms that both lack; counted on one of the two sides
                sums += np.array([source < o for o, _ in out]) * kept * abs(q - p0)
            for at in range(0, len(out), 4096):
                some = zip(out[at : at + 4096], sums[at : at + 4096].tolist(), strict=True)
                yield _batch(PAIRS, [(lang, min(source, o), max(source, o), v) for (o, _), v in some])


def source_divergence(docs: DataFrame, min_docs=MIN_DOCS, top=TOP_TERMS, block_entries=BLOCK_ENTRIES, slice_bytes=SLICE_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how every source differs from the others and from its language.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source
    uses more than its language does.  A language without kept terms has pairs of value 0 and no terms; a
    source alone in its language has no pairs.  Nulls read as empty; repeated rows count each; an empty
    table gives an empty result; further columns are not read.
    """
    groups = _filled(docs).select("lang", "source").distinct()
    kept = kept_table(term_frequencies(docs, min_docs, block_entries, slice_bytes), "frequencies")
    each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select(
        "lang", "term", F.col("e.sources").alias("source"), F.col("e.counts").alias("count")
    )
    zero = F.lit(0).cast("long")
    own = each.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", zero, lambda a, x: a + x)).alias("all"))
    stats = groups.join(own, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "kept", "all"])
    stats = kept_table(stats.withColumn("p0", F.when(F.col("kept") > 0, _share(F.lit(0), "total", "kept"))), "groups")
    small = bounded_broadcast(stats)

    whole = each.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"))
    posts = each.join(small, ["lang", "source"]).join(whole, ["lang", "term"])
    posts = kept_table(
        posts.select(
            "lang", "term", "source", "p0", _share("count", "total", "kept").alias("p"), _share("lang_count", "all", "kept").alias("q")
        ),
        "shares",
    )

    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = posts.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    hist = posts.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    hist = hist.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("hist"))
    blocks = max(1, -(-stats.count() // BLOCK_SOURCES))
    others = stats.groupBy("lang", bucket_of(blocks, "source").alias("block")).agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    # a block of the sources of the language with every source: as large as the rows asked for, 2048 at a time
    faced = stats.join(hist, ["lang", "source"], "left").join(bounded_broadcast(others, 4 * blocks + 1000), "lang")
    base = faced.select("lang", "source", "p0", "kept", "hist", "others").mapInArrow(_against, PAIRS)
    common = posts.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings"))
    corrections = common.where("size(postings) > 1").select("lang", "postings").mapInArrow(_tiled, PAIRS)
    sums = base.unionByName(corrections).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))
    pairs = sums.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", "s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(words.withColumn("part", F.lit("term")).select(*columns))
    )
