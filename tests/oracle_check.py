"""Run named queries in Spark and their oracle in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

from soundfield.plans.tables import RAW


def oracle_connection(folder: str):
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def compare(spark, con, name, build, sql, folder) -> tuple[bool, str]:
    t0 = time.time()
    df = build(spark, folder)
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    timing = f"spark {t1 - t0:5.1f}s oracle {t2 - t1:5.1f}s rows {len(got)}"
    if sorted(df.columns) != sorted(want_cols):
        return False, f"{timing} columns {sorted(df.columns)} vs {sorted(want_cols)}"
    a, b = _rows(df.columns, got), _rows(want_cols, want)
    if len(a) != len(b):
        return False, f"{timing} row count {len(a)} vs {len(b)}"
    exact = sum(x == y for x, y in zip(a, b))
    if exact == len(a):
        return True, timing
    bad = next((x, y) for x, y in zip(a, b) if x != y)
    return False, f"{timing} equal {exact}/{len(a)} first {bad}"
