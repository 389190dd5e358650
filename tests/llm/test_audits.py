"""Order MinHash, source divergence and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import conversations, divergence
from newsloom.llm import order_minhash as omh

MASK = (1 << 64) - 1


def mixed_by_force(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def kmer_by_force(run):
    h = 0
    for c in run:
        h = (h * omh.POLYNOMIAL + ord(c) + 1) & MASK
    return mixed_by_force(h)


def minhash_by_force(text, k=omh.K):
    runs = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    seen, kmers = Counter(), []
    for place, run in enumerate(runs):
        h = kmer_by_force(run)
        rank = h if not seen[run] else mixed_by_force((h + seen[run] * omh.POLYNOMIAL) & MASK)
        seen[run] += 1
        kmers.append((rank >> 32, place, h))
    out = []
    for xor, factor in zip(omh.XORS.tolist(), omh.FACTORS.tolist(), strict=True):
        least = sorted(((rank ^ xor) * factor % (1 << 32), place, h) for rank, place, h in kmers)[: omh.TUPLE]
        entry = 0
        for _, _, h in sorted(least, key=lambda e: e[1]):
            entry = mixed_by_force((entry * omh.POLYNOMIAL + h + 1) & MASK)
        out.append(entry >> 48)
    return out


@pytest.mark.parametrize("text", ["", "a", "short", "exactly8", "ab" * 40, "the cat sat on the mat " * 9, "naïve 中文 😀 " * 7, "x" * 3000])
def test_order_minhash(text):
    assert omh.order_minhash(text).tolist() == minhash_by_force(text)


def test_order_minhash_of_long_texts():
    rnd = random.Random(1)
    text = " ".join(rnd.choice("one two three four five six".split()) + str(rnd.randrange(90)) for _ in range(4000))
    whole = omh.order_minhash(text)
    assert whole.tolist() == minhash_by_force(text)
    assert (omh.order_minhash(text, class_kmers=1000) == whole).all()
    # edits in place change few entries, the same words in another order change most
    near = omh.order_minhash(text[:9000] + "x" + text[9000:])
    words = text.split()
    rnd.shuffle(words)
    assert np.mean(near == whole) > 0.9 and np.mean(omh.order_minhash(" ".join(words)) == whole) < 0.3


def fingerprints_by_force(rows):
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        own, new, its = (omh.order_minhash(t) for t in (text, edited, following))
        likeness = [float(np.mean(own == other)) for other in (new, its)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes(), new.tobytes(), *likeness))
    return out


def test_fingerprints_of_documents(spark, unique):
    rows = sorted(((r.doc_id, r.text or "") for r in unique.collect()), key=lambda r: -r[0])
    wide = unique.selectExpr("*", "1 AS part", "2 AS fingerprint", "3 AS border")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = {r.doc_id: tuple(r) for r in omh.fingerprint_documents(wide).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert found == {r[0]: r for r in fingerprints_by_force(rows)}
    one = omh.fingerprint_documents(unique.where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert omh.fingerprint_documents(unique.limit(0)).count() == 0


def test_fingerprints_of_repeated_rows(small):
    rows = omh.fingerprint_documents(small).collect()
    assert len(rows) == small.count() and sum(r.doc_id is None for r in rows) == 1
    by_text = {}
    for r, text in ((r, t) for r in rows for i, t in [(x.doc_id, x.text) for x in small.collect()] if i == r.doc_id):
        by_text.setdefault(text or "", set()).add(bytes(r.fingerprint))
    assert all(len(v) == 1 for v in by_text.values())


# ---- divergence


def divergence_by_force(rows, min_docs, top):
    docs = [(lang or "", source or "", text or "") for lang, source, text in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [[w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for _, _, t in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [(d[1], w) for d, w in zip(docs, words, strict=True) if d[0] == lang]
        in_docs = Counter(w for _, ws in mine for w in set(ws))
        kept = [w for w, n in in_docs.items() if n >= min_docs]
        sources = {s for s, _ in mine}
        counts = {s: Counter(w for t, ws in mine if t == s for w in ws) for s in sources}
        counts[None] = Counter(w for _, ws in mine for w in ws)
        share = {}
        for s, c in counts.items():
            total = sum(c[w] for w in kept) + 5 * len(kept)
            share[s] = {w: 1 + 1_000_000_000 * (c[w] + 5) // total for w in kept}
        for s in sources:
            pairs = [(sum(abs(share[s][w] - share[o][w]) for w in kept), o) for o in sources - {s}]
            terms = [(share[s][w] - share[None][w], w) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda e: (-e[0], e[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def test_divergence(spark, monkeypatch):
    rnd = random.Random(3)
    known = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Äpfel", "ÉTÉ", "中文", "😀x"]
    rows = [
        (rnd.choice(["en", "de"]), f"s{rnd.randrange(7)}", " ".join(rnd.choice(known[: rnd.randrange(2, 64)]) for _ in range(rnd.randrange(60))))
        for _ in range(150)
    ]
    rows += [("en", "s1", "The the THE it's a_b x1y2")] * 12 + [(None, None, None), ("en", None, "wa wb"), ("fr", "alone", ""), ("it", "a", "x"), ("it", "b", None)]
    # one very long document of a hot source
    rows += [("en", "s0", " ".join(rnd.choice(known) + "-" for _ in range(3000)))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, p int, term string").repartition(5)
    expected = divergence_by_force(rows, 12, 9)
    assert {tuple(r) for r in divergence.source_divergence(docs, 12, 9).collect()} == expected
    # blocks of few entries: many runs, documents in parts, segments of few terms
    monkeypatch.setattr(divergence, "SEGMENT_TERMS", 5)
    small = divergence.source_divergence(docs, 12, 9, block_entries=20, slice_bytes=64).collect()
    assert len(small) == len(expected) and {tuple(r) for r in small} == expected
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_merge_of_many_runs():
    rnd = random.Random(5)
    known = sorted(f"{a}{b}".encode() for a in "abcdefgh" for b in "abcdefgh")
    runs, counts, docs = [], Counter(), Counter()
    for run in range(40):
        tag = 0 if run % 4 else 1 + run // 8
        picked = sorted(rnd.sample(known, 20))
        in_docs = np.array([1 if tag else rnd.randrange(4) for _ in picked])
        postings = [] if tag else [(x, rnd.randrange(3), rnd.randrange(1, 9)) for x in rnd.sample(range(20), 20)]
        for w, n in zip(picked, in_docs.tolist(), strict=True):
            docs[w] += 0 if tag else n
        for x, i, c in postings:
            counts[picked[x], f"s{i}"] += c
        arrays = tuple(np.array(postings, np.int64).reshape(-1, 3).T)
        for batch in divergence.segments("en", ["s0", "s1", "s2"], picked, in_docs, arrays, tag, 3):
            runs += [tuple(r.values()) for r in batch.to_pylist()]
        docs.update({(w, tag): 1 for w in picked if tag and not docs[w, tag]})
    runs.sort(key=lambda r: r[:3])
    found = {w: (n, sums) for _, w, n, sums in divergence.merged(iter(runs), 0)}
    assert {(w, s): c for w, (_, sums) in found.items() for s, c in sums.items()} == dict(counts)
    whole = {w: docs[w] + sum(n for t, n in docs.items() if isinstance(t, tuple) and t[0] == w) for w in found}
    assert {w: n for w, (n, _) in found.items()} == whole


def test_tiles_are_flushed(spark, monkeypatch):
    rows = [("en", f"s{i:02}", f"a b{chr(97 + i % 5)} c{chr(97 + i % 3)} " * (i + 1)) for i in range(30)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "TILE", 4)
    monkeypatch.setattr(divergence, "TILES_HELD", 3)
    frames = [
        (lang, list(postings))
        for lang, postings in [
            ("en", [{"source": f"s{i:02}", "p": 10 * i + j, "p0": i} for i in range(30) if (i + j) % 3]) for j in range(8)
        ]
    ]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"lang": a, "postings": b} for a, b in frames])
    sums = Counter()
    for out in divergence._tiled(iter([batch])):
        for r in out.to_pylist():
            sums[r["lo"], r["hi"]] += r["value"]
    expected = Counter()
    for _, postings in frames:
        for x, y in itertools.combinations(postings, 2):
            extra = abs(x["p"] - y["p"]) - abs(x["p"] - y["p0"]) - abs(x["p0"] - y["p"]) + abs(x["p0"] - y["p0"])
            expected[x["source"], y["source"]] += extra
    assert {k: v for k, v in sums.items() if v} == {k: v for k, v in expected.items() if v}
    assert {tuple(r) for r in divergence.source_divergence(docs, 3, 4).collect()} == divergence_by_force(rows, 3, 4)


# ---- conversations


def edits_by_force(rows, costs, inserts):
    """Cheapest, then ASCII-least edits over all lists of edits; rows are (role, text, fault)."""
    rerole, delete, insert, cut = costs
    best = None
    spots = [[c for n in range(inserts + 1) for c in itertools.product("ua", repeat=n)]] * (len(rows) + 1)
    choices = [("D",) if f in ("blank", "duplicate") else ("K", "Ru", "Ra", "D") for _, _, f in rows]
    for placed in itertools.product(*spots):
        if sum(map(len, placed)) > inserts:
            continue
        for ops in itertools.product(*choices):
            audit, turns, cost = "", [], insert * sum(map(len, placed))
            for i, spot in enumerate(placed):
                audit += "I" * len(spot)
                turns += [(conversations.ROLES[c], "") for c in spot]
                if i == len(rows):
                    break
                role, text, fault = rows[i]
                audit += ops[i][0]
                if ops[i] == "D":
                    cost += delete
                    continue
                cost += (rerole if ops[i] != "K" else 0) + (cut if fault == "truncated" else 0)
                turns.append((role if ops[i] == "K" else conversations.ROLES[ops[i][1]], text))
            if all(r for r, _ in turns) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def decoded(rows):
    decoder, edits = conversations.Decoder(), []
    for row in rows:
        edits += decoder.step(row, row[0], row[2])
    rest, inserted, cost = decoder.finish()
    audit, turns = "", []
    for (role, text, _), before, edit, new_role in edits + rest:
        audit += "I" * len(before) + edit
        turns += [(conversations.ROLES[c], "") for c in before]
        if edit != "D":
            assert edit == "R" or new_role == role
            turns.append((new_role, text))
    return cost, audit + "I" * len(inserted), turns + [(conversations.ROLES[c], "") for c in inserted]


@pytest.mark.parametrize("costs", [(1, 2, 5, 5), (1, 4, 1, 2), (2, 2, 1, 0), (1, 1, 1, 1), (3, 2, 2, 1)])
def test_cheapest_edits(monkeypatch, costs):
    for name, value in zip(("REROLE_COST", "DELETE_COST", "INSERT_COST", "TRUNCATED_COST"), costs, strict=True):
        monkeypatch.setattr(conversations, name, value)
    rnd = random.Random(sum(costs))
    for _ in range(60):
        rows = [
            (rnd.choice(["user", "assistant", "system", "unknown", "tool", ""]), f"t{i}", rnd.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for i in range(rnd.randrange(4))
        ]
        assert decoded(rows) == edits_by_force(rows, costs, 3)


def test_final_edits_leave_early():
    rnd = random.Random(2)
    decoder, most, n = conversations.Decoder(), 0, 0
    for i in range(20_000):
        role = ("user", "assistant")[i % 2] if rnd.random() < 0.9 else "system"
        n += len(decoder.step(i, role, None if rnd.random() < 0.9 else "blank"))
        most = max(most, len(decoder.waiting))
    assert most < 400 and n > 19_000


ALIKE = [  # conv_id, turn, role, text; 40 copies of these under other ids meet every kind of damage
    (0, "system", "be kind."), (1, "user", "hello there?"), (2, "assistant", "yes."), (3, "user", " \n"), (4, "user", "why"),
    (5, "assistant", "so."), (6, "assistant", "so."), (9, "tool", "x!"), (None, None, "no turn."), (12, "user", None), (13, "user", "hello there?"),
]


def repaired_by_force(rows):
    damaged, ids = {}, {r[0] for r in rows}
    for conv_id, turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        row = (turn, "user" if fault == 4 else role, text)
        damaged.setdefault(conv_id, []).extend([] if fault == 0 else [row] * (2 if fault == 3 else 1))
    out = {}
    for conv_id in ids:
        mine = sorted(damaged[conv_id], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marked, counts = set(), [], Counter()
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, fixed = decoded(marked)
        whole = "\n".join(f"{r}:{t}" for r, t in fixed)
        out[conv_id] = (conv_id, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())
    return out


def test_repaired_conversations(spark):
    rnd = random.Random(4)
    rows = [(c, t, r, x) for c in range(40) for t, r, x in rnd.sample(ALIKE, rnd.randrange(1, len(ALIKE)))]
    rows += [(None, t, r, x) for t, r, x in ALIKE] + [(7_000, 3, "user", "again.")] * 5
    # ids of which the only row is dropped
    rows += [(c, 0, "user", "x.") for c in range(100, 160)]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, last int, edit string").repartition(3)
    turns = conversations.repaired_turns(conversations.damage(table))
    found = {r.conv_id: tuple(r) for r in conversations.repair_audit(turns).collect()}
    expected = repaired_by_force(rows)
    assert found == expected and any(v[7] == "" and v[1:7] == (0,) * 6 for v in expected.values())
    by_turns = {}
    for r in turns.where("edit IS NOT NULL").collect():
        by_turns.setdefault(r.conv_id, []).append((r.position, r.edit))
    assert all("".join(e for _, e in sorted(v)) == expected[c][7] for c, v in by_turns.items())
    assert conversations.repair_audit(conversations.repaired_turns(conversations.damage(table.limit(0)))).count() == 0


def test_long_conversation(spark):
    """All rows of one conversation, all of one role: survivors never meet, ties at every step."""
    rows = [(1, t, "user", f"row {t}.") for t in range(6000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.repair_audit(conversations.repaired_turns(conversations.damage(table))).collect()
    assert {r.conv_id: tuple(r) for r in found} == repaired_by_force(rows)
