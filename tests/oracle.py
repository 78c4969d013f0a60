"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else f"{float(value):.6f}"
    return str(value)


def compare(df, con, sql):
    """None if both agree, else a short description of the difference."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    right = sorted(tuple(_plain(r[i]) for i in at) for r in expected)
    left = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    if left == right:
        return None
    a, b = set(left) - set(right), set(right) - set(left)
    return f"{len(left)} rows != {len(right)} rows, e.g. {columns}: {sorted(a)[:3]} != {sorted(b)[:3]}"
