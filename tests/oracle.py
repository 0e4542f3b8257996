"""Compares a query with its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(x):
    """A comparable form of a value: floats to 9 digits, nested values as tuples."""
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, con: duckdb.DuckDBPyConnection) -> int:
    """Equal columns and equal rows, in any order; the number of rows."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    want = rows_of(names, expected.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got == want, f"only in Spark: {list((got - want).items())[:3]}; only in SQL: {list((want - got).items())[:3]}"
    return sum(got.values())
