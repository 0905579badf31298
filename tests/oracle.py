"""Compares a query with its SQL on the same tables: columns by name, rows as multisets."""

import glob
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both agree; else what differs."""
    df = query(spark, sf_dir)
    cur = tables(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
