"""Compare a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connection(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


def check(df, con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(plain([row[columns.index(c)] for c in order]) for row in result.fetchall())
    got = sorted(plain([row[c] for c in order]) for row in df.collect())
    assert got == want
