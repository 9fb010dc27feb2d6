"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(p) or glob.glob(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def value(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in found)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    want = got.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, want)
    return "" if a == b else f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:2]}, only in SQL {list((b - a).items())[:2]}"
