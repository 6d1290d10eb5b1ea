"""Spark results against DuckDB's, as the value hash compares them: columns by name, rows in no order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return db


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows(columns: list[str], found: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(r[i]) for i in order)) for r in found)


def differences(spark_df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree."""
    r = db.sql(sql)
    want, have = rows(r.columns, r.fetchall()), rows(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    if sorted(r.columns) != sorted(spark_df.columns):
        return f"columns {sorted(r.columns)} and {sorted(spark_df.columns)}"
    if want == have:
        return ""
    a, b = set(want) - set(have), set(have) - set(want)
    return f"{len(want)} and {len(have)} rows; only SQL: {sorted(a)[:2]}; only Spark: {sorted(b)[:2]}"
