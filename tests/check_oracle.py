"""Run queries next to their SQL and compare rows: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else (str(value) if math.isnan(value) else float(f"{value:.12g}"))
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.monotonic()
    df = contract.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.monotonic() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    start = time.monotonic()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    note = f"spark {len(got)} rows {spent:.1f}s, sql {len(want)} rows {time.monotonic() - start:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return False, f"{note}: {str(bad)[:900]}"
    return True, note


def main() -> None:
    from tests.conftest import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or contract.queries():
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(failed, "failed")


if __name__ == "__main__":
    main()
