"""Runs a query's SQL in DuckDB over the same tables and compares whole results."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def same_as_sql(df, sql, sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = c.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = sorted(map(repr, (tuple(r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall())))
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == want
    return len(want)
