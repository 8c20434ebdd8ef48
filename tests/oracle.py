"""Comparison of a Spark query with its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(value, v))
    return v


def same(spark, sf_dir, query, sql) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    order = [list(rel.columns).index(c) for c in columns]
    want = Counter(tuple(value(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
