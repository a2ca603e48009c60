"""Spark results against DuckDB's over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def _plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v


def rows_of(df) -> list[str]:
    cols = sorted(df.columns)
    return sorted(str([_plain(r[c]) for c in cols]) for r in (x.asDict() for x in df.collect()))


def duck_rows(sql: str, sf_dir: str) -> list[str]:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(str([_plain(r[i]) for i in order]) for r in got.fetchall())
