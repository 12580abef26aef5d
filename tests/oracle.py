"""Side-by-side comparison of a query with its SQL in DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        if glob.glob(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def compare(df, sql: str, d: str) -> None:
    rel = connect(d).sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    mine = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
    at = [rel.columns.index(n) for n in names]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, wrong[:3]
