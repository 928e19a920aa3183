"""Comparing a query's rows with those of its SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def tables(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NA or v != v:
        return "NULL"
    return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_text, r)) for r in frame.itertuples(index=False))


def same(spark, sf: str, query, sql: str) -> None:
    mine, theirs = query(spark, sf).toPandas(), tables(sf).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)
