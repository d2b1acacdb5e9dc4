"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder=SMALL):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


def same(df, sql, con):
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows(names, got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(have) == len(want)
    for a, b in zip(have, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (x is not None and y is not None and isinstance(x, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(y))), (a, b)
