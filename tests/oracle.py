"""Run a query and its SQL over the same tables and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb
from pyspark.sql import Row

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, (Row, tuple, list)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, SQL {sorted(names)}"
    want = Counter(tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
