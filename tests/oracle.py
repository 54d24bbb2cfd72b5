"""Compare queries with their SQL: ``python tests/oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def _rows(names: list[str], rows) -> Counter:
    at = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in at) for r in rows)


def compare(spark, con, sf: str, run, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = run(spark, sf)
    got = df.collect()
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    left, right = _rows(df.columns, got), _rows(names, want)
    if left != right:
        more, less = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"{len(got)} rows against {len(want)}; only here {more}; only in SQL {less}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from sedge.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, con, sql = local_session(), connect(folder), oracle_sql()
    wanted = sys.argv[2:]
    bad = []
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, run, sql[name])
                state = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                df = run(spark, folder)
                state = f"rows {len(df.collect())} {df.columns}"
        except Exception as error:  # noqa: BLE001
            state = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        if not state.startswith(("ok", "rows")):
            bad.append(name)
        print(f"{time.time() - began:6.2f}s {name}: {state[:1800]}", flush=True)
    print("bad:", bad)
