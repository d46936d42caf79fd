"""Comparison of a query with its reference SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def compare(df, con, sql):
    """Rows of both sides, by sorted column names."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted(([cell(r[c]) for c in cols] for r in df.collect()), key=repr)
    want = sorted(([cell(r[c]) for c in cols] for r in want), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for x, y in zip(g, w):
            assert x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-6 * max(1, abs(y)), (g, w)
