"""Comparison of a query with its SQL, as unordered rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def same(df, sql, folder):
    names, want = rows_of(sql, folder)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.collect())
    at = [names.index(c) for c in order]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want)
    return len(got)
