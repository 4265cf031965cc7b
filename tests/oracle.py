"""The driver's comparison in small: a query's rows against its SQL in DuckDB."""

import glob
import os
from collections import Counter

import duckdb


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def compare(spark, name, query, sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns, name
    want = Counter(tuple(_plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert got == want, (name, list((got - want))[:3], list((want - got))[:3])
