"""Compare a Spark result with a DuckDB statement over the same parquet tables."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from tessera.sources.bindings import TABLES

SF_SMALL = "/root/testdata/sf0.01"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return v.item()
    return v


def compare(spark_df, con, sql: str, digits: int = 6):
    cols = sorted(spark_df.columns)
    rel = con.sql(sql)
    dcols = sorted(rel.columns)
    if cols != dcols:
        return False, f"columns differ: spark={cols} duck={dcols}"
    srows = [tuple(_norm(r[c], digits) for c in cols) for r in spark_df.collect()]
    drows_raw = rel.fetchall()
    idx = [rel.columns.index(c) for c in cols]
    drows = [tuple(_norm(r[i], digits) for i in idx) for r in drows_raw]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    srows.sort(key=key)
    drows.sort(key=key)
    if len(srows) != len(drows):
        return False, f"row count differs: spark={len(srows)} duck={len(drows)}"
    for a, b in zip(srows, drows):
        if a != b:
            return False, f"first differing row:\n spark={a}\n duck ={b}\n cols={cols}"
    return True, f"{len(srows)} rows match"
