"""Compare a Spark query with its DuckDB SQL: columns by name, rows in any order, values exactly."""

import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str([_plain(x) for x in v]) if isinstance(v, list) else str(v)


def assert_same(spark, folder, fn, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = fn(spark, folder)
    got = df.collect()
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = found.fetchall()
    cols = sorted(names)
    assert sorted(df.columns) == cols
    left = sorted(tuple(_plain(r[c]) for c in cols) for r in got)
    right = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in want)
    assert left == right
