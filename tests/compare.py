"""Run registered queries against their SQL oracles: ``python tests/compare.py <sf_dir> [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


def difference(mine, theirs) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} / {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return f"rows {len(a)} / {len(b)}; only ours {len(only_a)}: {only_a[:3]}; only oracle {len(only_b)}: {only_b[:3]}"


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from newsloom.session import build_session

    spark = build_session(cores=8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or list(queries):
        start = time.time()
        try:
            mine = queries[name](spark, sf_dir).toPandas()
            mid = time.time()
            if name not in oracles:
                print(f"ROWS {name} {len(mine)} {mid - start:.1f}s", flush=True)
                continue
            problem = difference(mine, con.execute(oracles[name]).df())
            took = f"{mid - start:.1f}s sql {time.time() - mid:.1f}s rows {len(mine)}"
        except Exception as error:  # keep comparing the rest
            problem, took = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took} {(problem or '')[:900]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) != 0)
