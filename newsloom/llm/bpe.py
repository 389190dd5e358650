"""Byte-level BPE with a minimal acyclic transducer as lexicon.

Frequent words of the corpus and their ids are compiled into an automaton that shares suffixes: states
with the same continuations are one state, and the index of a word is the sum of the numbers on its arcs,
so any finite set of words maps to its rows of ids.  The compiled tables are flat integer arrays that every
worker maps into memory.  Words outside the lexicon are merged exactly by the rank of their pairs.

Text is cut at single blanks.  A blank after a non-blank always starts a new pre-token, and nothing left
of it or right of the next such blank decides how the piece between them is cut; so many texts are cut into
pieces at once, a distinct piece of them is cut and looked up once, and ids are put together as arrays.
"""

from __future__ import annotations

import json
import mmap
import re
import sys
import tempfile
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

# fixed value: the pattern by which byte-level BPE cuts text before its merges
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# the same for texts of PLAIN characters only, where the standard module knows the classes
PLAIN_PATTERN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ɏ]+|\s+(?!\S)|\s+""")
# ASCII without the separators that only Python counts as blank, Latin letters, dashes and quotes
NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ɏ‐-‧]")
# where a cut at single blanks would not be independent
CROWDED = re.compile(" {0}|{0} ".format("[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"))
# other blanks of plain texts: a run of them between two characters that are not blank starts a pre-token, too
LINE_ENDS = ("\t", "\n", "\x0b", "\x0c", "\r")
assert array("I").itemsize == 4 and sys.byteorder == "little"
# characters of the texts that are cut together, if there are several
TOGETHER = 1 << 20
LONG_BLANK = re.compile(r"\s{500}")
_NONE = 1 << 30


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return tuple(letters[b] for b in range(256))


class Vocabulary:
    """Pairs with their rank and result, ids of bytes, bytes of ids, and the special tokens."""

    def __init__(self, file: bytes):
        data = json.loads(file)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        ids = data["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in ids.items()}
        self.byte_id = [ids[letter] for letter in byte_letters()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[ids[a], ids[b]] = (rank, ids[a + b])
        order = sorted(self.pairs)
        self.pair_keys = np.array([(a << 32) | b for a, b in order], np.int64)
        self.pair_ranks = np.array([self.pairs[pair][0] for pair in order], np.int32)
        self.rank_result = np.empty(len(order), np.int32)
        for rank, merged in self.pairs.values():
            self.rank_result[rank] = merged
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged, leftmost first, until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        get, none = self.pairs.get, (1 << 30, 0)
        found = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none or best[0] == none[0]:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), none)
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        import heapq

        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(a: int) -> None:
            b = right[a]
            if b >= 0 and (found := self.pairs.get((ids[a], ids[b]))):
                heapq.heappush(heap, (found[0], a, ids[a], ids[b], found[1]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, x, y, merged = heapq.heappop(heap)
            b = right[a]
            if ids[a] != x or b < 0 or ids[b] != y:
                continue
            ids[a], ids[b] = merged, -1
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            right[b] = -1
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        return [i for i in ids if i >= 0]

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of every pair of ids, _NONE where the pair does not merge or an id is missing (-1)."""
        keys = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (b >= 0), self.pair_ranks[at], np.int32(_NONE))

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens; words of one length are merged together, a pair per word and round."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for length, members in by_length.items():
            if length > 48 or len(members) < 4:
                for i in members:
                    out[i] = array("I", self.merge(words[i])).tobytes()
                continue
            raw = np.frombuffer(b"".join(words[i] for i in members), np.uint8).reshape(-1, length)
            ids = self.byte_ids[raw]
            left = np.full(len(members), length)
            ranks = np.full((len(members), length), _NONE, np.int32)
            if length > 1:
                ranks[:, :-1] = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            rows, now, part = np.arange(len(members)), ids, ranks
            columns = np.arange(length)
            while True:
                at = part.argmin(1)
                best = part[np.arange(len(rows)), at]
                open_ = best < _NONE
                if not open_.all():
                    ids[rows] = now
                    rows, at, best, now, part = rows[open_], at[open_], best[open_], now[open_], part[open_]
                if not len(rows):
                    break
                line = np.arange(len(rows))
                now[line, at] = self.rank_result[best]
                # what stands behind the merged pair moves one place to the left
                where = columns + (columns > at[:, None])
                where[:, -1] = length - 1
                flat = where + (line * length)[:, None]
                now, kept = now.ravel()[flat], part.ravel()[flat]
                now[:, -1] = -1
                kept[:, -1] = _NONE
                after, before = np.minimum(at + 1, length - 1), np.maximum(at - 1, 0)
                behind = self._pair_ranks(now[line, at], now[line, after])
                ahead = self._pair_ranks(now[line, before], now[line, at])
                kept[line, before] = np.where(at > 0, ahead, behind)
                kept[line, at] = np.where(at + 1 < length, behind, _NONE)
                part = kept
                left[rows] -= 1
            packed = ids.astype("<u4")
            for line, i in enumerate(members):
                out[i] = packed[line, : left[line]].tobytes()
        return out


def pretokens(text: str) -> list[str]:
    plain = text.isascii() and text.isprintable() or not NOT_PLAIN.search(text)
    return (PLAIN_PATTERN if plain else PATTERN).findall(text)


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary_of(file: bytes) -> Vocabulary:
    """The parsed vocabulary, kept by a worker for its next tasks."""
    if file not in _LOADED:
        _LOADED.clear()
        _LOADED[file] = Vocabulary(file)
    return _LOADED[file]


class Transducer:
    """Minimal acyclic automaton of a set of words, with a list of ids per word.

    Tables (all little-endian unsigned 32-bit): per state its first arc; per arc label, target and the
    number of words before it; per state whether a word ends there; then offsets and ids of the words in
    their order.
    """

    HEADER = 8

    def __init__(self, buffer):
        words = memoryview(buffer).cast("I")
        parts, at = [], self.HEADER
        for n in words[:7]:
            parts.append(words[at : at + n])
            at += n
        self.first, self.label, self.target, self.before, self.final, self.offsets, self.ids = parts
        self.root = words[7]
        # state and label of every arc as one rising number, and one that no arc has
        states = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(np.asarray(self.first)))
        self.arc_keys = np.append((states << 8) | np.asarray(self.label), np.iinfo(np.int64).max)

    @classmethod
    def compile(cls, words: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """Builds the automaton from words in rising byte order, merging equal suffix states as it goes."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def frozen(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # [final, arcs]; the last arc of a node leads to the next
        previous, offsets, ids = b"", [0], []
        for word, word_ids in words:
            if word <= previous and offsets != [0]:
                raise ValueError("words must be distinct and in rising order")
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            for depth in range(len(previous), common, -1):
                path[depth - 1][1].append((previous[depth - 1], frozen(path.pop())))
            for _ in word[common:]:
                path.append([False, []])
            path[-1][0] = True
            previous = word
            ids += word_ids
            offsets.append(len(ids))
        for depth in range(len(previous), 0, -1):
            path[depth - 1][1].append((previous[depth - 1], frozen(path.pop())))
        root = frozen(path[0])
        # a state is frozen after its targets, so their counts are known
        counts = np.zeros(len(states), np.int64)
        first, label, target, before = [0], [], [], []
        for number, (final, arcs) in enumerate(states):
            total = int(final)
            for byte, to in arcs:
                label.append(byte)
                target.append(to)
                before.append(total)
                total += int(counts[to])
            counts[number] = total
            first.append(len(label))
        tables = [first, label, target, before, [int(final) for final, _ in states], offsets, ids]
        out = [np.array([*map(len, tables), root], "<u4"), *(np.array(t, "<u4") for t in tables)]
        return b"".join(t.tobytes() for t in out)

    def find(self, word: bytes) -> bytes | None:
        """Packed ids of ``word``; None for a word that was not compiled."""
        state, number = self.root, 0
        first, label, before, target = self.first, self.label, self.before, self.target
        for byte in word:
            end = first[state + 1]
            at = bisect_left(label, byte, first[state], end)
            if at == end or label[at] != byte:
                return None
            number += before[at]
            state = target[at]
        if not self.final[state]:
            return None
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tobytes()

    def find_many(self, words: pa.Array, after: bytes = b"") -> np.ndarray:
        """Number of every word with ``after`` before it, -1 for one that was not compiled.

        All words walk at once, a byte per round, and leave where no arc goes on.
        """
        data, offsets = utf8(words)
        out = np.full(len(words), -1, np.int64)
        rows, at, end = np.arange(len(words)), offsets[:-1], offsets[1:]
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        target, before, final = np.asarray(self.target), np.asarray(self.before), np.asarray(self.final)
        depth = 0
        while len(rows):
            if depth < len(after):
                label = np.full(len(rows), after[depth])
            else:
                ended = at == end
                if ended.any():
                    out[rows[ended]] = np.where(final[state[ended]], number[ended], -1)
                    rows, at, end, state, number = (a[~ended] for a in (rows, at, end, state, number))
                label = data[at]
                at = at + 1
            key = (state << 8) | label
            arc = np.searchsorted(self.arc_keys, key)
            goes = self.arc_keys[arc] == key
            arc = arc[goes]
            rows, at, end = rows[goes], at[goes], end[goes]
            state, number = target[arc].astype(np.int64), number[goes] + before[arc]
            depth += 1
        return out

    @property
    def n_states(self) -> int:
        return len(self.final)


def mapped(tables: bytes) -> mmap.mmap:
    """The compiled tables in a mapped file without a name, so nothing stays behind."""
    file = tempfile.TemporaryFile()
    file.write(tables)
    file.flush()
    return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def utf8(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow column of strings without nulls, and where each string starts; the last entry is the end."""
    blob = words.cast(pa.large_binary())
    offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1] if len(blob) else np.zeros(1, np.int64)
    return np.frombuffer(blob.buffers()[2] or b"", np.uint8), offsets


def taken(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``starts``, one behind the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def column(words: Iterable[str]) -> pa.Array:
    return pa.array(words if isinstance(words, list) else list(words), pa.large_string())


def found(pattern: re.Pattern, texts: pa.Array) -> np.ndarray:
    """Whether ``pattern`` is found in each text."""
    return np.asarray(pc.match_substring_regex(texts, pattern.pattern).to_numpy(zero_copy_only=False), bool)


def at_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """Texts cut at every blank: distinct pieces, their numbers in the order of the texts, where each text starts
    (the last entry is the end), and the first piece of each text, which has no blank before it."""
    cut = pc.split_pattern(texts, " ")
    coded = cut.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype(np.int64)
    heads = coded.dictionary.take(coded.indices.take(pa.array(starts[:-1])))
    return coded.dictionary, np.array(coded.indices), starts, listed(heads)


def together(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in groups of at most about TOGETHER characters, or one text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit), exactly as the vocabulary's own tokenizer.

    ``lexicon`` has the ids of frequent pre-tokens; all others are merged.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.special = {c: array("I", [i]).tobytes() for c, i in vocabulary.special.items()}
        self.library = library_encoding(vocabulary)
        self.token_bytes = np.array([len(vocabulary.bytes_of.get(i, b"")) for i in range(max(vocabulary.bytes_of) + 1)], np.int64)

    def _ids_of_words(self, words: pa.Array, blank: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pre-tokens, lexicon first, all other words merged together; with ``blank`` they are words of
        letters, and a blank stands before each.

        Many ids, and where in them those of each word start and how many they are.
        """
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        values = []
        unseen = np.arange(len(words))
        if self.lexicon:
            number = self.lexicon.find_many(words, b" " if blank else b"")
            known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
            offsets = np.asarray(self.lexicon.offsets).astype(np.int64)
            starts[known], lengths[known] = offsets[number[known]], np.diff(offsets)[number[known]]
            values.append(np.asarray(self.lexicon.ids))
        new = words.take(pa.array(unseen))
        if blank:
            new = pc.binary_join_element_wise(pa.scalar("", new.type), new, pa.scalar(" ", new.type))
        if not self.library:
            of_letters = np.zeros(len(new), bool)
        else:
            of_letters = np.ones(len(new), bool) if blank else np.array([w.removeprefix(" ").isalpha() for w in listed(new)], bool)
        for members, merged in (of_letters, self._merge_letters), (~of_letters, self._merge_others):
            if members.any():
                ids, first, n = merged(new.filter(pa.array(members)))
                starts[unseen[members]], lengths[unseen[members]] = first + sum(map(len, values)), n
                values.append(ids)
        return np.concatenate([*values, np.zeros(0, np.uint32)]), starts, lengths

    def _merge_letters(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words of letters, with or without a blank before them, merged in one call.

        A line feed between two such words is a pre-token of its own, so the ends of the tokens tell the
        ids of one word from those of the next.
        """
        ids = self.library.encode_to_numpy("\n".join(listed(words)), disallowed_special=()).astype(np.uint32)
        ends = np.cumsum(self.token_bytes[ids])
        sizes = np.diff(utf8(words)[1])
        starts = np.cumsum(sizes + 1) - sizes - 1
        low, high = np.searchsorted(ends, starts, "right"), np.searchsorted(ends, starts + sizes, "right")
        return ids, low, high - low

    def _merge_others(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        merged = self.vocabulary.merge_many([w.encode() for w in listed(words)])
        lengths = np.array([len(m) // 4 for m in merged], np.int64)
        return np.frombuffer(b"".join(merged), "<u4"), np.cumsum(lengths) - lengths, lengths

    def _ids_of_pieces(self, after_blank: pa.Array, whole: pa.Array, cut: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for pieces of plain characters, first those that follow a blank, and for pre-tokens of other texts."""
        one_word = np.asarray(pc.utf8_is_alpha(after_blank).to_numpy(zero_copy_only=False), bool)
        values, first, n = self._ids_of_words(after_blank.filter(pa.array(one_word)), blank=True)
        composed = listed(after_blank.filter(pa.array(~one_word)))
        parts = [PLAIN_PATTERN.findall(piece if piece.startswith(LINE_ENDS) else " " + piece) for piece in composed]
        parts += map(PLAIN_PATTERN.findall, listed(whole))
        parts += ([word] for word in listed(cut))
        words = column(chain.from_iterable(parts)).dictionary_encode()
        order = np.asarray(words.indices)
        ids, at, size = self._ids_of_words(words.dictionary)
        size = size[order]
        ids = taken(ids, at[order], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, parts)])]
        where = np.concatenate([np.flatnonzero(one_word), np.flatnonzero(~one_word), len(one_word) + np.arange(len(whole) + len(cut))])
        starts, lengths = np.empty(len(where), np.int64), np.empty(len(where), np.int64)
        starts[where] = np.concatenate([first, ends[:-1] + len(values)])
        lengths[where] = np.concatenate([n, np.diff(ends)])
        return np.concatenate([values, ids]), starts, lengths

    def _parts(self, text: str) -> Iterator[str | bytes]:
        """Plain parts of a text as strings, special tokens as packed ids."""
        pattern = self.vocabulary.special_pattern
        at = 0
        for match in pattern.finditer(text) if pattern else ():
            yield text[at : match.start()]
            yield self.special[match.group()]
            at = match.end()
        yield text[at:]

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        # per text the packed ids of its special tokens and the numbers of its other parts
        mine: list[list[int | bytes]] = []
        parts: list[str] = []
        for text in texts:
            mine.append([])
            for part in self._parts(text):
                mine[-1].append(part if isinstance(part, bytes) else len(parts))
                if not isinstance(part, bytes):
                    parts.append(part)
        texts = column(parts)
        plain = ~found(NOT_PLAIN, texts)
        spaced = plain & ~found(CROWDED, texts)
        kinds = [np.flatnonzero(kind) for kind in (spaced, plain & ~spaced, ~plain)]
        # cut before other blanks as well: a piece that begins with one has no single blank before it
        spaced = pc.replace_substring_regex(texts.take(pa.array(kinds[0])), "([\t-\r]+)", r" \1")
        after_blank, codes, starts, heads = at_blanks(spaced)
        crowded = [re.findall(r"\s*\S+|\s+", parts[i]) for i in kinds[1]]
        cut = [pretokens(parts[i]) for i in kinds[2]]
        whole = column(chain(heads, *crowded)).dictionary_encode()
        words = column(chain(*cut)).dictionary_encode()
        numbers = np.asarray(whole.indices) + len(after_blank)
        codes[starts[:-1]] = numbers[: len(heads)]
        codes = np.concatenate([codes, numbers[len(heads) :], np.asarray(words.indices) + len(after_blank) + len(whole.dictionary)])
        starts = np.concatenate([starts, starts[-1] + np.cumsum([*map(len, crowded), *map(len, cut)], dtype=np.int64)])
        values, at, n = self._ids_of_pieces(after_blank, whole.dictionary, words.dictionary)
        values = values.astype("<u4")
        blocks = (codes[i : i + (1 << 18)] for i in range(0, len(codes), 1 << 18))
        packed = b"".join([taken(values, at[block], n[block]).tobytes() for block in blocks])
        ends = (4 * np.concatenate([[0], np.cumsum(n[codes])])[starts]).tolist()
        place = np.empty(len(parts), np.int64)
        place[np.concatenate(kinds)] = np.arange(len(parts))
        of_part = [packed[ends[i] : ends[i + 1]] for i in place.tolist()]
        return [b"".join([p if isinstance(p, bytes) else of_part[p] for p in own]) for own in mine]

    def encode_many(self, texts: Iterable[str]) -> list[bytes]:
        return [packed for group in together(texts) for packed in self._encode_group(group)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


_ENCODERS: dict[tuple[int, int], Encoder] = {}
_LIBRARY: dict[int, Callable[[str], bytes] | None] = {}


def library_of(vocabulary: Vocabulary) -> Callable[[str], bytes] | None:
    if id(vocabulary) not in _LIBRARY:
        _LIBRARY.clear()
        _LIBRARY[id(vocabulary)] = library_encoder(vocabulary)
    return _LIBRARY[id(vocabulary)]


def encoder_of(vocabulary: Vocabulary, lexicon: bytes | None) -> Encoder:
    """The encoder of a worker, kept for the next tasks."""
    key = (id(vocabulary), hash(lexicon))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, None if lexicon is None else Transducer(mapped(lexicon)))
    return _ENCODERS[key]


class Decoder:
    """Ids back to text; bytes that are not UTF-8 become the replacement character."""

    def __init__(self, vocabulary: Vocabulary):
        parts = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(parts), np.uint8)

    def _bytes(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        where = np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))
        return self.blob[where].tobytes()

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        parts = [self._bytes(ids[at : at + (1 << 18)]) for at in range(0, len(ids), 1 << 18)]
        return b"".join(parts).decode("utf-8", "replace")


def summed(words: list[pa.Array], counts: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of several columns and the sums of their counts."""
    coded = pa.concat_arrays(words).dictionary_encode()
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, np.asarray(coded.indices), np.concatenate(counts))
    return coded.dictionary, sums


def words_of(texts: Iterable[str], vocabulary: Vocabulary) -> tuple[pa.Array, np.ndarray]:
    """Distinct pre-tokens of all texts and their counts, with equal pieces cut only once."""
    pattern = vocabulary.special_pattern
    whole: Counter[str] = Counter()
    distinct, times = [column([])], [np.zeros(0, np.int64)]
    for group in together(texts):
        parts = column(part for text in group for part in (pattern.split(text) if pattern else [text]))
        crowded = found(CROWDED, parts)
        after_blank, codes, starts, heads = at_blanks(parts.filter(pa.array(~crowded)))
        whole.update(heads)
        whole.update(listed(parts.filter(pa.array(crowded))))
        counts = np.bincount(codes, minlength=len(after_blank)) - np.bincount(codes[starts[:-1]], minlength=len(after_blank))
        distinct.append(after_blank.filter(pa.array(counts > 0)))
        times.append(counts[counts > 0])
    after_blank, counts = summed(distinct, times)
    one_word = np.asarray(pc.utf8_is_alpha(after_blank).to_numpy(zero_copy_only=False), bool)
    composed: dict[str, int] = {}
    spaced = zip((" " + piece for piece in listed(after_blank.filter(pa.array(~one_word)))), counts[~one_word].tolist(), strict=True)
    for piece, n in chain(spaced, whole.items()):
        for word in pretokens(piece):
            composed[word] = composed.get(word, 0) + n
    blank, nothing = pa.scalar(" ", after_blank.type), pa.scalar("", after_blank.type)
    words = pc.binary_join_element_wise(nothing, after_blank.filter(pa.array(one_word)), blank)
    return summed([words, column(composed)], [counts[one_word], np.array(list(composed.values()), np.int64)])


def library_encoding(vocabulary: Vocabulary) -> tiktoken.Encoding | None:
    """The installed library's encoding, if the rank of every merge is the id of its result."""
    ids = [merged for _, (_, merged) in sorted(vocabulary.pairs.items(), key=lambda item: item[1][0])]
    if ids != sorted(ids) or (ids and min(ids) < 256) or sorted(vocabulary.byte_id) != list(range(256)):
        return None
    special = set(vocabulary.special.values())
    ranks = {raw: i for i, raw in vocabulary.bytes_of.items() if i not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens=vocabulary.special)


def library_encoder(vocabulary: Vocabulary) -> Callable[[str], bytes] | None:
    """Packed ids of whole texts by the installed tokenizer library."""
    plain = Encoder(vocabulary)
    own = plain.library
    if own is None:
        return None

    def encode(text: str) -> bytes:
        # the library's pattern engine does not finish on very long runs of blanks
        if LONG_BLANK.search(text):
            return plain.encode(text)
        return own.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()

    return encode
