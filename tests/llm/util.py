"""Runs a query's SQL in DuckDB over the same tables and compares whole results."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_as_sql(df, sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = c.sql(sql)
    want = sorted(map(repr, (tuple(r) for r in rel.select(*sorted(rel.columns)).fetchall())))
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    assert got == want
    return len(got)
