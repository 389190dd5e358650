"""Work of searches and counts in bounded pieces, with the results of the plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from newsloom.operators import features, fuzzy, retrieval
from newsloom.operators import postings as P


def words(n, seed, letters="abcdé", longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_bounds_of_all_pairs_are_not_below_their_scores():
    left, right = words(80, 1), words(90, 2)
    of_left, of_right = np.divmod(np.arange(80 * 90), 90)
    want = np.array([fuzzy.jaro_winkler(left[i], right[j]) for i, j in zip(of_left, of_right)])
    assert np.array_equal(fuzzy.pair_scores(left, right, of_left, of_right), want)
    assert (fuzzy.all_bounds(left, right).ravel() - want).min() > -fuzzy.BOUND_MARGIN


@pytest.mark.parametrize("most", [1, 1 << 10, 1 << 20])
def test_remembered_pairs_give_the_best_scores(most):
    """Much room and so little that pairs are forgotten between and within the articles."""
    asked, known = words(40, 3, longest=9), words(300, 4, longest=9)
    pairs = fuzzy._Pairs(asked, most)
    rows = [(np.arange(0, 40, 1 + i % 3), random.Random(i).sample(known, k)) for i, k in enumerate((0, 1, 7, 200, 40, 300))]
    for _ in range(2):
        for (mine, text), best in zip(rows, pairs.best(rows), strict=True):
            want = [max((fuzzy.jaro_winkler(asked[i], w) for w in text), default=0.0) for i in mine]
            assert np.array_equal(best, want)


def test_articles_are_scored_once_for_all_queries(spark, monkeypatch):
    """Equal to the scores per hit; repeated hits and articles, texts without words and queries in blocks."""
    monkeypatch.setattr(fuzzy, "QUERY_BLOCK", 2)
    queries = [("q1", "Straße des Herzogs", False), ("q2", "strasse", True), ("q3", "...", False), ("q4", "herzog markt", False), ("q5", "markt", True)]
    queries = spark.createDataFrame(queries, "qid string, q string, title_only boolean")
    rows = [("a", "Der Herzog", " und der Markt"), ("a", "Die Strasse", None), ("b", None, None), ("c", "Marktstraße", " am Herzogplatz")]
    articles = spark.createDataFrame(rows, "id string, article_title string, article_text_beginning string")
    hits = [(q, i) for q in ("q1", "q2", "q3", "q4", "q5") for i in ("a", "b", "c")] + [("q1", "a"), ("q4", "none")]
    hits = spark.createDataFrame(hits, "qid string, id string")
    got = fuzzy.article_scores(hits, articles, queries).orderBy("qid", "id").collect()
    want = fuzzy.hit_scores(fuzzy.token_scores(hits, articles, queries)).orderBy("qid", "id").collect()
    assert [r[:2] for r in got] == [r[:2] for r in want] and got
    assert all(x[2:] == pytest.approx(y[2:]) for x, y in zip(got, want))


def batch(n):
    rng = random.Random(5)
    vocabulary = words(400, 6, letters="abcdeé", longest=8)

    def lists(most):
        return [None if rng.random() < 0.1 else rng.choices(vocabulary, k=rng.randint(0, most)) for _ in range(n)]

    columns = [pa.array(lists(m), pa.list_(pa.string())) for m in (5, 20, 60, 1, 2)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([str(i) for i in range(n)])], [*"abcde", "id"])


def test_words_are_counted_a_few_articles_at_a_time():
    given = batch(2 * P.ROWS + 30)
    made = list(P._count_words(iter([given])))
    assert [b.num_rows for b in made] == [P.ROWS, P.ROWS, 30]
    rows = [r for b in made for r in b.to_pylist()]
    for i, row in enumerate(rows):
        want = {}
        for number in range(len(P.FIELDS)):
            for word in given.column(number)[i].as_py() or ():
                want[number, word] = want.get((number, word), 0) + 1
        assert len(set(row["words"])) == len(row["words"])
        got = {(f, row["words"][p]): c for f, p, c in zip(row["fields"], row["places"], row["counts"], strict=True)}
        assert row["id"] == str(i) and got == want


def test_asked_terms_are_found_like_by_looking_at_every_place():
    asked = P.Asked()
    for word in words(60, 7, letters="abcdeé", longest=8):
        asked.words.setdefault(word, len(asked.words))
        for size in P.GRAM_SIZES:
            for i in range(len(word) - size + 1):
                asked.grams.setdefault(word[i : i + size], len(asked.grams))
    texts = [*list(asked.words)[:20], *words(300, 8, letters="abcdeéxy\U00010400", longest=12), ""]
    hits, ends = P._term_hits(pa.array(texts), asked)
    for i, word in enumerate(texts):
        want = [asked.words[word]] if word in asked.words else []
        grams = [word[j : j + size] for size in P.GRAM_SIZES for j in range(len(word) - size + 1)]
        want += [len(asked.words) + asked.grams[g] for g in grams if g in asked.grams]
        assert sorted(hits[ends[i - 1] if i else 0 : ends[i]].tolist()) == sorted(want)


def test_more_articles_are_counted_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "ARTICLES_A_TASK", 2)
    rows = [("2024-01-01", f"a{i}", "word and word") for i in range(60)]
    articles = spark.createDataFrame(rows, "day string, id string, text string")
    counts = features.term_counts(articles, {"tfidf": articles["text"]})
    assert "hashpartitioning(id" in counts._jdf.queryExecution().executedPlan().toString()
    assert ", 30)" in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r["term"], r["tf"]) for r in counts.collect()} == {("word", 2), ("and", 1)} and counts.count() == 120


def asked_of(texts):
    asked = P.Asked()
    for i, text in enumerate(texts):
        found = list(dict.fromkeys(text))
        asked.qids.append(str(i))
        asked.word_terms.append(np.array([asked.words.setdefault(w, len(asked.words)) for w in found]))
        grams = [w[j : j + n] for w in found for n in P.GRAM_SIZES for j in range(len(w) - n + 1)]
        asked.gram_terms.append(np.array([asked.grams.setdefault(g, len(asked.grams)) for g in dict.fromkeys(grams)], np.int64))
    return asked


@pytest.mark.parametrize(("most", "cells"), [(P.KNOWN_WORDS, P.TABLE_CELLS), (50, 10)])
def test_a_word_is_searched_for_terms_once(monkeypatch, most, cells):
    """Counts are those of a plain count, also when words are forgotten and tables would be too large."""
    monkeypatch.setattr(P, "KNOWN_WORDS", most)
    monkeypatch.setattr(P, "TABLE_CELLS", cells)
    monkeypatch.setattr(P, "CHUNK_ROWS", 100)
    searched = []
    plain = P._term_hits
    monkeypatch.setattr(P, "_term_hits", lambda words, asked: searched.extend(words.to_pylist()) or plain(words, asked))
    given = batch(2 * P.ROWS + 30)
    asked = asked_of([words(4, seed, letters="abcdeé", longest=8) for seed in range(5)])
    stored = pa.Table.from_batches(P._count_words(iter([given]))).combine_chunks().to_batches()[0]
    rows = []
    known = P._Known(asked)
    for part, places in P._known_slices(iter([stored]), [known]):
        row, number, term, count = P._term_counts(part, places[0], known, P.FIELDS)
        rows += [{} for _ in range(part.num_rows)]
        for r, f, t, n in zip(row + len(rows) - part.num_rows, number, term, count, strict=True):
            rows[r][int(f), int(t)] = int(n)
    assert most == 50 or len(searched) == len(set(searched)) > 0
    df = {}
    for i, got in enumerate(rows):
        want = {}
        for number, name in enumerate(P.FIELDS):
            for word in given.column(number)[i].as_py() or ():
                terms = [asked.words[word]] if word in asked.words and name in P.WORD_FIELDS else []
                grams = [word[j : j + n] for n in P.GRAM_SIZES for j in range(len(word) - n + 1)]
                for term in terms + [len(asked.words) + asked.grams[g] for g in grams if g in asked.grams]:
                    want[number, term] = want.get((number, term), 0) + 1
        assert got == want
        for key in want:
            df[key] = df.get(key, 0) + 1
    (counted,) = P._count_documents([asked], P.FIELDS)(iter([stored]))
    assert df == {divmod(c, asked.n_terms): n for c, n in zip(counted["cell"].to_pylist(), counted["n"].to_pylist(), strict=True)}


def test_a_search_for_words_leaves_the_full_text_alone(spark):
    """Whole words do not count in the full text, so without n-grams its words are neither found nor written."""
    row = ("a", "one", "one two", "one two three", "src", ["author"])
    articles = spark.createDataFrame([row], "id string, article_title string, article_text_beginning string, article_text string, source_name string, article_authors array<string>")
    stored = P.postings(articles, fields=P.WORD_FIELDS).first()
    assert sorted(stored["words"]) == ["author", "one", "src", "two"] and P.FIELDS.index("article_text") not in stored["fields"]
    assert "three" in P.postings(articles).first()["words"]


def test_best_hits_are_sorted_in_when_enough_wait(monkeypatch):
    """The best of all batches, with ties by id and open, bad and given ends; a batch does not sort in every query."""
    rng = random.Random(9)
    asked = asked_of([["w"]] * 4)
    asked.extra = {"target": [0] * 4, "low": [None, 40, None, (1 << 63) - 1], "high": [None, None, 60, None], "vector": [None] * 4}
    monkeypatch.setattr(retrieval, "_cosines", lambda asked, column: np.zeros((4, len(column))))
    sorted_in = []
    plain = retrieval._Best.sort_in
    monkeypatch.setattr(retrieval._Best, "sort_in", lambda self, i: sorted_in.append(i) or plain(self, i))
    kernel, state, want = retrieval._best_hits(5), {}, [[] for _ in range(4)]
    for b in range(20):
        ids = [f"{b:02}{i}" for i in range(3)]
        ts = [rng.choice([None, *range(100)]) for _ in ids]
        given = pa.RecordBatch.from_pydict({"id": ids, "ts": pa.array(ts, pa.int64()), "bonus": [0.0] * 3, "central": [1.0] * 3, "vector": [None] * 3})
        scores = np.array([[float(rng.randint(0, 3)) for _ in ids] for _ in range(4)])
        assert not list(kernel(given, asked, (scores, np.zeros((4, 3)), np.zeros((4, 3))), state))
        for q in range(4):
            for i, t, score in zip(ids, ts, scores[q]):
                low, high = asked.extra["low"][q], asked.extra["high"][q]
                if score and (low is None or t is not None and t >= low) and (high is None or t is not None and t <= high):
                    want[q].append((-round(score * (3 if t is not None else 2) * 3, 9), i))
    assert len(sorted_in) < 4 * 20 / 2
    rows = pa.Table.from_batches(kernel(None, None, None, state)).to_pylist()
    for q in range(4):
        assert [(-r["score"], r["id"]) for r in rows if r["qid"] == str(q)] == sorted(want[q])[:5]
    assert len(want[0]) > 5 and not want[3]


def test_known_pairs_are_not_copied_for_every_article(monkeypatch):
    copied = []
    plain = np.concatenate
    monkeypatch.setattr(fuzzy.np, "concatenate", lambda x, *a, **b: copied.append(1) or plain(x, *a, **b))
    pairs = fuzzy._Pairs(words(5, 3, longest=9), 1 << 20)
    for seed in range(100):
        pairs.add(words(3, seed, longest=30))
    assert len(copied) < 30 and len(pairs.words) == len(pairs.bounds) == len(pairs.scores)


def test_words_are_scored_by_bits_as_letter_by_letter():
    """Words up to and beyond the 32 letters of a number, an empty one, letters beyond 16 bits, and pairs asked twice."""
    left = ["", "a", "martha", "dwayne", "jellyfish", "𝔞𝔟𝔠é", "ab" * 16, "ba" * 16 + "x", *words(40, 11, longest=34)]
    right = ["", "marhta", "duane", "smellyfish", "𝔟𝔞𝔠", "ba" * 16, "ab" * 17, *words(40, 12, longest=34)]
    of_left, of_right = np.divmod(np.arange(len(left) * len(right)), len(right))
    want = np.array([fuzzy.jaro_winkler(left[i], right[j]) for i, j in zip(of_left, of_right)])
    short = np.array([max(len(left[i]), len(right[j])) <= fuzzy.LONGEST for i, j in zip(of_left, of_right)])
    coded = fuzzy._Coded(left, right)
    assert np.array_equal(coded.scores(of_left[short], of_right[short]), want[short])
    assert np.array_equal(fuzzy.pair_scores(left, right, of_left, of_right), want)
    pairs = fuzzy._Pairs(left, 1 << 16)
    rows = pairs.add(right)
    cells = (rows[:, None] * len(left) + np.arange(len(left))).ravel()
    pairs.score([cells, cells[::3], cells[::-1]])
    assert np.array_equal(pairs.scores, want.reshape(len(left), len(right)).T)
