"""Spark rows against DuckDB rows on the same tables."""

import glob
import math

import duckdb


def duck(sql, sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([norm(y) for y in x])
    return str(x)


def same(df, sql, sf_dir):
    names, rows = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [names.index(c) for c in cols]
    b = sorted(tuple(norm(r[i]) for i in at) for r in rows)
    assert len(a) == len(b), (len(a), len(b))
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, (len(diff), diff[:3])
