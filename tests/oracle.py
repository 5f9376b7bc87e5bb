"""Comparison of a query with its DuckDB oracle."""

import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


def same(spark, folder, name, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[k]) for k in columns) for r in df.collect())
    cur = connect(folder).execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == columns, name
    assert ours == sorted(tuple(plain(r[theirs.index(k)]) for k in columns) for r in cur.fetchall()), name
