"""Comparing a query with its SQL on the small tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str, columns: list[str], views: dict[str, str] | None = None) -> list[str]:
    c = duckdb.connect()
    for t in TABLES:
        path = (views or {}).get(t, f"{sf_dir}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    names = ", ".join(f'"{x}"' for x in columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in c.sql(f"SELECT {names} FROM ({sql})").fetchall())


def plain(v):
    if isinstance(v, float) and v == int(v):
        return int(v)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    return v


def frame_rows(df) -> list[str]:
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.collect())


def check_query(spark, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    rows = frame_rows(df)
    assert rows == sql_rows(sf_dir, sql, df.columns)
    return len(rows)
