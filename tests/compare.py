"""Spark rows against DuckDB rows of the same query."""

import datetime
import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder=DATA):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def order(row):
    return [(v is None, isinstance(v, str), int(v) if isinstance(v, bool) else v if v is not None else 0) for v in row]


def same(x, y):
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return x == y or abs(x - y) <= 1e-7 * max(1, abs(x))
    return x == y


def check(df, sql, con):
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=order)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(([plain(r[i]) for i in at] for r in cursor.fetchall()), key=order)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)
