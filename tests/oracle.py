"""Runs a query in Spark and its SQL in DuckDB over the same tables, and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.environ.get("TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x: object) -> object:
    if isinstance(x, float):
        return round(x, 9) + 0.0 if x == x else "nan"
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(_plain, x))
    if hasattr(x, "asDict"):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    return x


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, f, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = f(spark, sf_dir)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        first = next(((a, b) for a, b in zip(ours, theirs, strict=False) if a != b), None)
        return f"{len(ours)} and {len(theirs)} rows; first difference {str(first)[:600]}"
    return ""
