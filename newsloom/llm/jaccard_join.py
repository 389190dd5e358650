"""Exact n-gram Jaccard join with prefix trees.

1.  Every text becomes a set of n-gram hashes (64 bits).  The hash space is cut into segments; two sets of
    at least the asked similarity differ in at most D elements, so of more than D segments at least one is
    the same in both.  A document announces the content of each of its segments as one key.  Documents
    that share a key form candidate clusters.  This is the first level of the tree, dealt to all machines:
    a key is a path from the root, and only documents on one path meet.
2.  In a cluster, distinct sets (copies are one set) are ordered by one global order of n-grams, frequent
    ones first, and stored in a trie.  Each set walks the trie once and shares the overlaps of common
    paths; a subtree is left as soon as the overlap so far, with all that remains of the walking set or
    below the node, cannot reach what the similarity asks.  Large clusters are cut into blocks, and pairs
    of blocks are the tasks.
3.  Links found are counted per document, and a forest of them gives the components.

No step writes all pairs of a group: keys give one edge per document to the smallest document of the key,
first inside each task, then over all tasks; tries give link counts and forest edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm.common import encoded, kept_table, pieces, ready
from newsloom.llm.components import connected

BLOCK_SETS = 256
BLOCK_GRAMS = 1 << 19
# segments are used from a similarity on that gives them this many elements
SEGMENT_GRAMS = 8
# a segment with at most this many elements says little
WEAK = 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash per word of a text in UTF-8, A-Z lower-cased."""
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    blank = _BLANK[data]
    edges = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, the whole sequence as one."""
    words = word_hashes(raw)
    if not len(words):
        return words
    width = min(n, len(words))
    grams = np.full(len(words) - width + 1, np.uint64(width))
    for i in range(width):
        grams = mix(grams * _BASE + words[i : len(words) - width + 1 + i])
    return np.unique(grams)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; equal sets have equal ones."""
    return int(mix(grams).sum().astype(np.int64)), int(mix(grams ^ _INVERSE).sum().astype(np.int64))


class Segments:
    """Segment keys of sets for one similarity, a fraction ``num`` / ``den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.limits = [1]  # class c holds sizes from limits[c] up to limits[c + 1] - 1

    def size_class(self, n: int) -> int:
        while self.limits[-1] <= n:
            last = self.limits[-1]
            # sizes last .. top may reach the similarity with each other
            self.limits.append(max(last + 1, last * self.den // self.num + 1))
        return int(np.searchsorted(self.limits, n, "right")) - 1

    @lru_cache(maxsize=4096)  # noqa: B019
    def plan(self, size_class: int) -> tuple[int, int]:
        """Number of segments and of weak segments that a set may leave out, for a size class."""
        top = self.limits[size_class + 1] - 1
        differ = 2 * top * (self.den - self.num) // (self.den + self.num)
        # the mean number of weak segments and three standard deviations are made up for
        weak, segments = 0, differ + 1
        for _ in range(20):
            mean = top / segments
            share = np.exp(-mean) * (1 + mean)
            weak = int(segments * share + 3 * np.sqrt(segments * share * (1 - share))) if segments > 4 else 0
            if differ + 1 + weak <= segments:
                break
            segments = differ + 1 + weak
        return segments, weak

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Keys of a set under its own size class and the next larger one.

        At least ``weak`` + 1 segments of a similar pair agree.  A set with at most ``weak`` weak segments
        leaves those out: one of the agreeing segments is then not weak, in either set.
        """
        own = self.size_class(len(grams))
        self.size_class(self.limits[own + 1])
        out = []
        for c in (own, own + 1):
            segments, weak = self.plan(c)
            high = grams >> np.uint64(32)
            number = ((high * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)
            starts = np.searchsorted(number, np.arange(segments + 1))
            counts = np.diff(starts)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ _BASE))))
            content = sums[starts[1:]] - sums[starts[:-1]]
            label = np.arange(segments, dtype=np.uint64) * _BASE + np.uint64(c)
            made = mix(mix(label) + content * _INVERSE + counts.astype(np.uint64))
            strong = counts > WEAK
            out.append(made[strong] if segments - int(strong.sum()) <= weak else made)
        return np.concatenate(out)


def _set_kernel(n: int):
    """Per document: id, set size and two halves of the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            rows = []
            for raw in encoded(batch.column(1)):
                grams = gram_set(raw, n)
                rows.append((len(grams), *fingerprint(grams)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "h1", "h2"])

    return run


def _key_kernel(n: int, num: int, den: int):
    """Per document: id, its keys, smaller documents met.

    Of the documents of a slice that share a key only the smallest announces it; the others are tied to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(num, den)
        for batch in pieces(batches, 2048):
            doc = batch.column(0).to_numpy()
            sets = [gram_set(raw, n) for raw in encoded(batch.column(1))]
            keys = [segments.keys(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key = np.concatenate(keys)
            order = np.lexsort((doc[owner], key))
            key, owner = key[order], owner[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.empty(0, bool)
            head = owner[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else owner
            announced = _lists(owner[new], key[new], len(keys))
            ties = _ties(owner[~new], doc[head[~new]], doc, len(keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), announced, ties], ["doc_id", "keys", "met"])

    return run


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    offsets = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].astype(np.int64)))


def _ties(owner: np.ndarray, other: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    pairs = np.unique(np.stack([owner, other], 1), axis=0) if len(owner) else np.empty((0, 2), np.int64)
    pairs = pairs[doc[pairs[:, 0]] != pairs[:, 1]]
    return _lists(pairs[:, 0], pairs[:, 1], n)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return ready(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def gram_sets(docs: DataFrame, n: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, h1, h2): size and fingerprint of every set."""
    return _named(docs, id_col, text_col).mapInArrow(_set_kernel(n), "doc_id long, n_shingles long, h1 long, h2 long")


def _gram_kernel(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            sets = [gram_set(raw, n).view(np.int64) for raw in encoded(batch.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["doc_id", "grams"])

    return run


def rare_prefix_edges(docs: DataFrame, sizes: DataFrame, n: int, num: int, den: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(a, b): every document tied to the smallest one with one of its rarest n-grams.

    For lower similarities segments get too small to tell documents apart.  Here the global order is by
    number of documents, then by hash, counted exactly.  A similar pair shares one of the first
    |x| - ceil(similarity * |x|) + 1 n-grams of either set; those of one document come first and need
    not be asked for, so a document with enough n-grams of its own has no candidates at all, and a
    passage that many documents share comes last.
    """
    named = _named(docs, id_col, text_col).where("doc_id IS NOT NULL")
    grams = named.mapInArrow(_gram_kernel(n), "doc_id long, grams array<long>").select("doc_id", F.explode("grams").alias("gram"))
    counted = grams.withColumn("df", F.count("*").over(W.partitionBy("gram")))
    shared = counted.where("df > 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("shared"))
    own = sizes.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    prefix = F.col("size") - F.ceil(F.col("size") * num / den) + 1
    asked = F.greatest(F.lit(0), prefix - (F.col("size") - F.size("shared"))).cast("int")
    first = shared.join(own, "doc_id").select("doc_id", F.explode(F.slice("shared", F.lit(1), asked)).alias("g"))
    least = F.first("doc_id").over(W.partitionBy("g").orderBy("doc_id"))
    return first.select(F.col("doc_id").alias("a"), least.alias("b")).where("a <> b").distinct()


class Trie:
    """Compressed prefix tree of sorted integer sets; nodes in order of depth."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.runs: list[np.ndarray] = []
        parent, longest, shortest, ends = [], [], [], []
        # (first set, last set, depth, parent node)
        level = [(0, len(order), 0, -1)]
        while level:
            following = []
            for lo, hi, depth, above in level:
                at = lo
                while at < hi:
                    if len(sets[order[at]]) == depth:  # ends at the parent
                        ends.append((order[at], above))
                        at += 1
                        continue
                    last = at
                    while last + 1 < hi and len(sets[order[last + 1]]) > depth and sets[order[last + 1]][depth] == sets[order[at]][depth]:
                        last += 1
                    # sorted by bytes: the common prefix of the first and the last is that of all
                    group = [sets[order[i]] for i in range(at, last + 1)]
                    deep = min(map(len, group))
                    for other in group[1:]:
                        apart = np.flatnonzero(other[depth:deep] != group[0][depth:deep])
                        if len(apart):
                            deep = depth + int(apart[0])
                    self.runs.append(group[0][depth:deep])
                    parent.append(above)
                    longest.append(max(map(len, group)))
                    shortest.append(min(map(len, group)))
                    following.append((at, last + 1, deep, len(parent) - 1))
                    at = last + 1
            level = following
        self.parent = np.array(parent, np.int64)
        self.longest, self.shortest = np.array(longest, np.int64), np.array(shortest, np.int64)
        lengths = np.array([len(r) for r in self.runs], np.int64)
        self.start = np.concatenate(([0], np.cumsum(lengths)))
        self.elements = np.concatenate(self.runs) if self.runs else np.empty(0, np.int64)
        self.depth = np.zeros(len(parent), np.int64)
        for i, above in enumerate(parent):
            self.depth[i] = lengths[i] + (self.depth[above] if above >= 0 else 0)
        self.children = {}
        for i, above in enumerate(parent):
            self.children.setdefault(above, []).append(i)
        self.children = {k: np.array(v) for k, v in self.children.items()}
        self.ends: dict[int, list[int]] = {}
        for which, node in ends:
            self.ends.setdefault(node, []).append(which)

    def search(self, grams: np.ndarray, marks: np.ndarray, num: int, den: int) -> list[int]:
        """Stored sets that reach the similarity num / den with ``grams`` (sorted); marks is scratch space."""
        size, found = len(grams), []
        marks[grams] = True
        stack = [(-1, 0)]
        while stack:
            node, overlap = stack.pop()
            for which in self.ends.get(node, ()):
                # |a & b| * den >= |a | b| * num
                if overlap * (den + num) >= num * (size + int(self.depth[node])):
                    found.append(which)
            for child in self.children.get(node, ()):
                shortest, longest = int(self.shortest[child]), int(self.longest[child])
                if longest * den < num * size or size * den < num * shortest:
                    continue
                run = self.elements[self.start[child] : self.start[child + 1]]
                shared = overlap + int(np.count_nonzero(marks[run]))
                # at best every element of the query behind this run, and all that is left below, still agrees
                behind = size - int(np.searchsorted(grams, run[-1], "right"))
                best = shared + min(behind, longest - int(self.depth[child]))
                if best * (den + num) >= num * (size + max(shortest, best)):
                    stack.append((child, shared))
        marks[grams] = False
        return found


def _rank_sets(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Hashes replaced by their place in the order: frequent ones first, then by hash."""
    everything = np.concatenate(sets)
    values, where, counts = np.unique(everything, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))
    ranked, at = [], 0
    for s in sets:
        # big-endian, so that the order of bytes is the order of numbers
        ranked.append(np.sort(rank[where[at : at + len(s)]]).astype(">i8"))
        at += len(s)
    return ranked, len(values)


def link_sets(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Index pairs of similar sets: inside ``left`` (i < j), or between ``left`` and ``right``."""
    ranked, universe = _rank_sets(left if right is None else left + right)
    marks = np.zeros(universe, bool)
    stored = [s for s in ranked[: len(left)]]
    trie = Trie(stored)
    if right is None:
        for i, s in enumerate(stored):
            yield from ((j, i) for j in trie.search(s.astype(np.int64), marks, num, den) if j < i)
    else:
        for i, s in enumerate(ranked[len(left) :]):
            yield from ((j, i) for j in trie.search(s.astype(np.int64), marks, num, den))


class _Forest:
    def __init__(self):
        self.above: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _trie_kernel(n: int, num: int, den: int):
    """Sorted input (task key, side, id, copies, h1, text) to rows (a, b, links): forest edges, or link counts with b null."""

    def solved(key, rows) -> pa.RecordBatch:
        itself = key[1] == key[2]  # a block with itself, or two blocks, of which one may be empty
        sides, sets, seen = ([], []), ([], []), set()
        for row in rows:
            grams = gram_set(row[4], n)
            # a repeated row, or another text under the same id
            if row[:4] in seen or fingerprint(grams)[0] != row[3]:
                continue
            seen.add(row[:4])
            sides[row[0]].append(row)
            sets[row[0]].append(grams)
        a_rows, b_rows = sides[0], sides[0 if itself else 1]
        forest, edges = _Forest(), []
        links: dict[int, int] = {}
        pairs = link_sets(sets[0], None if itself else sets[1], num, den) if a_rows and b_rows else ()
        for i, j in pairs:
            a, b = a_rows[i], b_rows[j]
            links[a[1]] = links.get(a[1], 0) + b[2]
            links[b[1]] = links.get(b[1], 0) + a[2]
            if forest.join(a[1], b[1]):
                edges.append((a[1], b[1]))
        out = [(a, b, 0) for a, b in edges] + [(a, None, k) for a, k in links.items()]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            rows = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5, 6)), encoded(batch.column(7)), strict=True)
            for key, row in zip(keys, rows, strict=True):
                if key != now:
                    if held:
                        yield solved(now, held)
                    now, held = key, []
                held.append(row)
        if held:
            yield solved(now, held)

    return run


def candidate_edges(docs: DataFrame, n: int, num: int, den: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(a, b): every document tied to the smallest one that announced one of its keys.

    Keys go from the kernel straight into the one shuffle; they are not stored.
    """
    named = _named(docs, id_col, text_col).where("doc_id IS NOT NULL")
    keyed = named.mapInArrow(_key_kernel(n, num, den), "doc_id long, keys array<long>, met array<long>")
    none = F.lit(None).cast("long")
    announced = F.transform("keys", lambda k: F.struct(k.alias("key"), none.alias("other")))
    ties = F.transform("met", lambda m: F.struct(F.col("doc_id").alias("key"), m.alias("other")))
    rows = keyed.select("doc_id", F.explode(F.concat(announced, ties)).alias("e")).select("doc_id", "e.key", "e.other")
    # a tie knows its smaller document already
    same_key = W.partitionBy("key", F.col("other").isNull()).orderBy("doc_id")
    least = F.coalesce("other", F.first("doc_id").over(same_key))
    return rows.select(F.col("doc_id").alias("a"), least.alias("b")).where("a <> b").distinct()


def jaccard_components(
    docs: DataFrame,
    n: int = 5,
    num: int = 80,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_sets: int = BLOCK_SETS,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    Two documents link when den * |intersection| >= num * |union| of their sets of distinct n-word
    shingles (A-Z lower-cased; the whole sequence when there are fewer words).  ``component_id`` is the
    smallest id that links reach, itself included; ``n_links`` counts linked documents, copies included.
    A text without words, or null, links with nothing; a row without id links with nothing and has no
    component.  Rows that repeat an id count as copies of each other.
    """
    sets = kept_table(gram_sets(docs, n, id_col, text_col), "grams")
    linkable = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = linkable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = kept_table(classes, "classes")
    # mean elements of a segment: (1 + similarity) / (2 - 2 * similarity)
    if den + num >= SEGMENT_GRAMS * 2 * (den - num):
        edges = candidate_edges(docs, n, num, den, id_col, text_col)
    else:
        edges = rare_prefix_edges(docs, linkable, n, num, den, id_col, text_col)
    clusters = connected(edges, "candidates")
    # the representatives of clusters with at least two different sets
    members = clusters.join(classes.select("rep", "copies", "n_shingles", "h1"), F.col("node") == F.col("rep"))
    members = kept_table(members.select("rep", "copies", "n_shingles", "h1", F.col("root").alias("cluster")), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("g")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / block_sets, F.col("g") / block_grams)).cast("int")
    asked = members.join(sizes.select("cluster", blocks.alias("blocks")), "cluster")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    # texts are dealt by id at every size, never joined to a broadcast list of candidates
    texts = asked.hint("merge").join(texts, "rep")
    # a block meets itself and every other block of its cluster once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = texts.select("cluster", "block", "rep", "copies", "h1", "text", other.alias("other")).select(
        "cluster",
        F.least("block", "other").alias("lo"),
        F.greatest("block", "other").alias("hi"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "rep",
        "copies",
        "h1",
        "text",
    )
    dealt = spread.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "side", "rep")
    found = kept_table(dealt.mapInArrow(_trie_kernel(n, num, den), "a long, b long, links long"), "links")
    joined = connected(found.where("b IS NOT NULL").select("a", "b"), "components")
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("linked"))
    named = (
        classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counted, "rep", "left")
        .select(
            "h1", "h2", "n_shingles", F.coalesce("root", "rep").alias("component"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    rows = sets.select("doc_id", "n_shingles", "h1", "h2")
    alone = rows.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    linked = rows.where("doc_id IS NOT NULL AND n_shingles > 0").join(named, ["h1", "h2", "n_shingles"])
    return linked.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("links").alias("n_links")).union(alone)
