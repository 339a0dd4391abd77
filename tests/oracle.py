"""Compares a query with its SQL on the same tables, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return db


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def difference(df, sql: str, db: duckdb.DuckDBPyConnection) -> str:
    """Empty if both give the same rows, else what differs."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    expected = Counter(tuple(plain(row[names.index(c)]) for c in order) for row in found.fetchall())
    actual = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    if actual == expected:
        return ""
    more, less = actual - expected, expected - actual
    return f"{sum(actual.values())} rows against {sum(expected.values())}; only in Spark: {list(more)[:3]}; only in SQL: {list(less)[:3]}; order {order}"
