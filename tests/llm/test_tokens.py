"""BPE, packing, sharding against the installed tokenizer and direct checks."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import bpe, packing, sharding, tokenize

PATH = public_tokenizers.path("byte_bpe_50k.json")
FILE = tokenize.vocabulary_file(PATH)
VOCABULARY = bpe.Vocabulary(FILE)
THEIRS = Tokenizer.from_file(PATH)
ENCODERS = bpe.Encoder(VOCABULARY), bpe.Encoder(VOCABULARY)


def ids_of(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from("ab  \n\t\r'sdl.!19é ßñ—“²½\u00a0\u3000中٣\x1c\x85_-😀"), max_size=20), st.sampled_from(["", "<|endoftext|>", "'re"]))
def test_encoders_agree(text, extra):
    text += extra + text[:3]
    want = packed(ids_of(text))
    assert bpe.Encoder(VOCABULARY).encode(text) == want
    assert bpe.library_encoder(VOCABULARY)(text) == want
    assert bpe.Decoder(VOCABULARY).decode(want) == THEIRS.decode(ids_of(text), skip_special_tokens=False)


def test_long_words_and_runs():
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "x" + "\n " * 900):
        assert bpe.Encoder(VOCABULARY).encode(text) == packed(ids_of(text))
        assert bpe.library_encoder(VOCABULARY)(text) == packed(ids_of(text))


def test_words_merged_together_are_as_one_by_one():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("thenigra é") for _ in range(rnd.randint(1, 12))).encode() for _ in range(500)]
    assert VOCABULARY.merge_many(words) == [packed(VOCABULARY.merge(w)) for w in words]


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 99), max_size=3), max_size=40))
def test_transducer(words):
    found = bpe.Transducer(bpe.mapped(bpe.Transducer.compile(sorted(words.items()))))
    assert all(found.find(w) == packed(ids) for w, ids in words.items())
    assert all(found.find(w + b"x") is None for w in words if w + b"x" not in words)


def test_transducer_shares_suffixes():
    words = [(a + b"ing", [1]) for a in (b"a", b"b", b"c")]
    assert bpe.Transducer(bpe.Transducer.compile(words)).n_states == 5


@settings(deadline=None, max_examples=100)
@given(st.sets(st.text("ab é", min_size=1, max_size=5), max_size=30), st.lists(st.text("ab é", max_size=5), max_size=30))
def test_words_walk_together_as_one_by_one(words, asked):
    compiled = sorted((w.encode(), [i]) for i, w in enumerate(words))
    lexicon = bpe.Transducer(bpe.Transducer.compile(compiled))
    numbers = {raw: i for i, (raw, _) in enumerate(compiled)}
    asked += words
    for after in ("", " "):
        got = lexicon.find_many(bpe.column(asked), after.encode()).tolist()
        assert got == [numbers.get((after + w).encode(), -1) for w in asked]
        assert [n >= 0 for n in got] == [lexicon.find((after + w).encode()) is not None for w in asked]


@settings(deadline=None, max_examples=200)
@given(
    st.lists(st.text(st.sampled_from("ab  \n\t\r'sdl.!19é ßñ—“²½\u00a0\u3000中٣\x1c\x85_-😀×ª"), max_size=15).flatmap(
        lambda text: st.sampled_from([text, f"{text}<|endoftext|>{text}", f"old {text} wall the"])), max_size=8),
    st.sampled_from([1, 20, 1000]),
)
def test_texts_encoded_together_are_as_one_by_one(texts, together):
    words = ["a", " a", " the", " wall", "old", " sd", "\n", " é"]
    lexicon = bpe.Transducer(bpe.Transducer.compile(sorted((w.encode(), VOCABULARY.merge(w.encode())) for w in words)))
    before, bpe.TOGETHER = bpe.TOGETHER, together
    try:
        assert ENCODERS[0].encode_many(texts) == [packed(ids_of(t)) for t in texts]
        ENCODERS[1].lexicon = lexicon
        assert ENCODERS[1].encode_many(texts) == [packed(ids_of(t)) for t in texts]
    finally:
        bpe.TOGETHER = before


def test_a_word_of_many_texts_is_looked_up_and_merged_once(monkeypatch):
    """Texts are encoded together: work per distinct word, not a walk in Python per word and small batch."""
    known = [" " + w for w in ("river", "stone", "garden")]
    lexicon = bpe.Transducer(bpe.Transducer.compile(sorted((w.encode(), VOCABULARY.merge(w.encode())) for w in known)))
    encoder = bpe.encoder_of(VOCABULARY, None)
    monkeypatch.setattr(encoder, "lexicon", lexicon, raising=False)
    asked, merged = [], []
    find_many, merge_letters = lexicon.find_many, encoder._merge_letters
    monkeypatch.setattr(lexicon, "find_many", lambda words, after: asked.extend((after, w) for w in words.to_pylist()) or find_many(words, after))
    monkeypatch.setattr(encoder, "_merge_letters", lambda words: merged.extend(words.to_pylist()) or merge_letters(words))
    texts = [f"river stone garden qxqa qxqb {i % 7}" for i in range(3000)]
    assert encoder.encode_many(texts) == [packed(ids_of(t)) for t in texts]
    assert len(asked) == len(set(asked)) < 20 and sorted(merged) == [" qxqa", " qxqb", "river"]


def test_portions_hold_texts_of_a_bounded_size():
    texts = ["é" * 3, None, "", "x" * 30, "ab", "cd" * 4, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["z", *texts, "z"])], ["n", "text"]).slice(1, 7)
    cut = list(tokenize.portions([batch, batch.slice(0, 0)], 1, 10))
    assert [p.column(1).to_pylist() for p in cut] == [texts[:3], texts[3:4], texts[4:]]


def test_encode_and_decode_tables(small):
    lexicon = tokenize.build_lexicon(small, FILE, words=50)
    rows = tokenize.decode(tokenize.encode(small, FILE, lexicon), FILE).collect()
    texts = {str(r.doc_id): r.text for r in small.collect()}
    assert len(rows) == small.count()
    for r in rows:
        assert bytes(r.ids) == packed(ids_of(texts[str(r.doc_id)])) and r.decoded == (texts[str(r.doc_id)] or "")
    assert tokenize.encode(small.limit(0), FILE, lexicon).count() == 0


def test_word_counts(small):
    want = defaultdict(int)
    for r in small.collect():
        for part in (r.text or "").split("<|endoftext|>"):
            for word in bpe.pretokens(part):
                want[word] += 1
    got = {r.word: r.n for r in tokenize.word_counts(small, FILE).collect()}
    assert got == {w: n for w, n in want.items() if len(w.encode()) <= tokenize.WORD_BYTES}


def check_packing(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(small):
    rows = packing.pack_documents(small, FILE).collect()
    check_packing(rows, 2048)
    pieces = defaultdict(list)
    for r in rows:
        pieces[str(r.doc_id)].append(r)
    for r in small.dropDuplicates(["doc_id"]).collect():
        ids = [*ids_of(r.text), 0]
        mine = sorted(pieces[str(r.doc_id)], key=lambda p: p.piece)
        if r.doc_id == 4:
            assert len(mine) == 2  # the repeated row has a place of its own
            continue
        assert [p.piece for p in mine] == list(range(len(mine)))
        assert all(p.length == 2048 for p in mine[1:])
        at = 0
        for p in mine:
            assert p.start == at and p.ids_crc32 == zlib.crc32(packed(ids[at : at + p.length])) and bytes(p.ids) == packed(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert packing.pack_documents(small.limit(0), FILE).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1, max_size=20))
def test_patterns_use_all_documents(counts):
    plan = packing.best_two_fit(counts, 60)
    used = defaultdict(int)
    for times, pattern in plan:
        assert times > 0 and sum(n * c for n, c in pattern.items()) <= 60
        for n, c in pattern.items():
            used[n] += times * c
    assert used == counts
    # no worse than half full on average
    assert sum(t for t, _ in plan) <= 2 * sum(n * c for n, c in counts.items()) / 60 + 1


def test_two_for_one():
    # 6 + 3 leaves a gap of one; 2 + 2 fits it better than 3
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=120), st.integers(2, 8))
def test_differencing(sizes, shards):
    place, totals = sharding.divide(np.array(sizes), shards)
    assert place.min() >= 0 and place.max() < shards
    assert np.bincount(place, np.array(sizes), minlength=shards).tolist() == totals.tolist()
    assert totals.max() - totals.min() <= max(sizes)


def greedy(sizes, shards):
    totals = [0] * shards
    for size in sorted(sizes, reverse=True):
        totals[totals.index(min(totals))] += size
    return totals


def test_differencing_against_greedy_and_optimum(sf_dir):
    rnd = np.random.default_rng(8)
    for _ in range(30):
        sizes = rnd.integers(1, 60, rnd.integers(1, 8))
        _, totals = sharding.divide(sizes, 3)
        least = min(np.bincount(p, sizes, 3).max() for p in itertools.product(range(3), repeat=len(sizes)))
        assert least <= totals.max() <= 4 / 3 * least
    for sizes in (rnd.lognormal(6, 1.2, 5000).astype(np.int64), rnd.integers(16, 4000, 3000)):
        _, totals = sharding.divide(sizes, 40)
        assert np.ptp(totals) <= np.ptp(greedy(sizes.tolist(), 40))


def test_shards_of_documents_are_level(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    groups = Counter()
    for r in docs.collect():
        groups[r.text] += len((r.text or "").encode()) + 16
    # all groups are units; groups are bundled, and only the largest are units
    for bundles in (sharding.BUNDLES, 300):
        totals = Counter()
        for r in sharding.shard_documents(docs, 40, bundles=bundles).collect():
            totals[r.shard] += r["size"]
        assert len(totals) == 40 and np.ptp(list(totals.values())) <= np.ptp(greedy(groups.values(), 40))


@pytest.mark.parametrize("bundles", [4, 1000])
def test_shards(small, bundles, monkeypatch):
    monkeypatch.setattr(sharding, "UNITS_A_SHARD", 2)
    rows = sharding.shard_documents(small, 4, bundles=bundles).collect()
    assert len(rows) == small.count()
    slots, shard_of = defaultdict(list), defaultdict(set)
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        slots[r.shard].append(r.slot)
        shard_of[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= {0, 1, 2, 3}
    assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shard_documents(small.limit(0), 4).count() == 0
