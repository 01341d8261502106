"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sql: str, sf_dir: str):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, df.collect()) == bag(names, rows)
