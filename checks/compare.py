"""Runs queries against their SQL twins."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(value + 0.0)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


def compare(spark, con, fn, sql: str, sf: str) -> str:
    """Empty if equal, else what differs."""
    t0 = time.time()
    df = fn(spark, sf)
    ours = [tuple(row) for row in df.collect()]
    t1 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    timing = f"spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s rows {len(ours)}"
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    a, b = _rows(df.columns, ours), _rows(cols, theirs)
    if a == b:
        compare.note = timing
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} against {len(b)}; ours only {only_a[:2]}; theirs only {only_b[:2]}; ndiff {len(only_a)},{len(only_b)}"


compare.note = ""
