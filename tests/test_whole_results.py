"""Similarity queries return all that meets the threshold, on tables of their own rows."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import difference

import __spark_entry__ as entry

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 3, 1)


def written(folder, times, texts, vectors):
    """Tables of as many documents as there are times, of three sources."""
    n = len(times)
    tables = {
        "documents": {
            "doc_id": pa.array(range(n), pa.int64()),
            "text": texts,
            "lang": ["en"] * n,
            "source": [f"s{i % 3}" for i in range(n)],
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        },
        "events": {"event_id": pa.array(range(n), pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "value": [float(i) for i in range(n)]},
        "embeddings": {"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))},
        "benchmark": {"item_id": pa.array(range(len(texts)), pa.int64()), "text": texts},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(folder, name):
    con = duckdb.connect()
    for table in ("documents", "events", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con.execute(entry.oracle_sql()[name]).df()


def test_embedding_similarity_returns_every_pair_with_its_similarity(spark, tmp_path):
    """The pairs themselves, equal to a dense matrix; a missing vector has none."""
    n, rng = 40, np.random.default_rng(8)
    rows = rng.normal(size=(n, 6)).astype(np.float32)
    vectors = [None if i % 9 == 4 else [float(x) for x in rows[i]] for i in range(n)]
    times = [START + (i % 2) * DAY for i in range(n)]
    folder = written(tmp_path, times, [f"Text {i}" for i in range(n)], vectors)
    mine = entry.queries()["embedding_similarity"](spark, folder).toPandas()
    want = {}
    for day in (0, 1):
        ids = [i for i in range(n) if i % 2 == day]
        dense = np.array([np.zeros(6) if vectors[i] is None else rows[i].astype(float) for i in ids])
        scores = np.round(dense @ dense.T, 9)
        scores[np.array([[a % 3 == b % 3 for b in ids] for a in ids])] = 0.0
        cut = max(np.percentile(scores, 90), 1e-12)
        for a, b in zip(*np.nonzero(np.triu(scores >= np.round(cut, 12), 1))):
            want[str((START + day * DAY).date()), f"{ids[a]:012}", f"{ids[b]:012}"] = min(scores[a, b], 1.0)
    got = {(r.day, r.id_a, r.id_b): r.sim for r in mine.itertuples()}
    assert len(got) == len(mine) and got.keys() == want.keys() and len(got) > 20
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)
    assert difference(mine, by_sql(folder, "embedding_similarity")) is None


def test_interval_links_reach_over_a_day(spark, tmp_path):
    """Articles of the days before and after a day, 30 hours apart, are linked in the window of that day."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma omega".split()
    texts, times = [], []
    for i in range(24):
        # every third article is of the middle day, and only the outer ones share their words
        day = i % 3
        texts.append(f"rivers {words[i // 3]} {words[i // 3]} bridge" if day != 1 else f"market {words[i // 3 + 6]} town")
        times.append(START + day * DAY + datetime.timedelta(hours=(20, 12, 2)[day]))
    folder = written(tmp_path, times, texts, [None] * 24)
    mine = entry.queries()["interval_similarity"](spark, folder).toPandas()
    assert difference(mine, by_sql(folder, "interval_similarity")) is None
    middle = mine[mine.day == str((START + DAY).date())].set_index("id")
    outer = [f"{i:012}" for i in range(24) if i % 3 != 1]
    assert len(middle) == 24 and (middle.loc[outer].n_links > 0).all()


def test_a_link_of_a_small_share_counts():
    """Half of a billionth in one kind alone is no similarity on the grid, but a kept cell."""
    from newsloom.operators import tiles as T

    rules = T.make_rules(T.KINDS)
    none = {k: (np.zeros(1, np.int32), np.zeros(0), None if k == "vector" else np.zeros(0, np.int32)) for k in T.KINDS}

    def side(weight, source):
        lists = none | {"title_ent": (np.ones(1, np.int32), np.array([weight]), np.zeros(1, np.int32))}
        return T.Side(np.array(["x"]), np.array([source]), np.zeros(1, np.int64), lists)

    row = {f"cut_{k}": pa.scalar(0.0) for k in T.KINDS}
    tile = T.Tile(None, side(2e-9, 0), side(1.0, 1), False, ["p", "q"], row, (0, 1))
    assert T.kept_scores(tile, rules)[0, 0] == 0.0 and T.linked_cells(tile, rules)[0, 0]
