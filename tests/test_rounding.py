"""Numbers and ranks as the SQL's engine makes them, bit for bit."""

import os

import duckdb
from pyspark.sql import functions as F

from gridweave.functions.numbers import rounded
from gridweave.plans import catalog
from tests.util import TABLES, same_as_sql

SF = "/root/testdata/sf0.001"


def test_rounds_as_sql(spark):
    """Halves in decimals that are none in doubles, or the other way round."""
    values = [s * (k / 2e6 + e) for k in range(1, 400_001, 1999) for e in (0.0, 500.0, 5e4, 1e9) for s in (1, -1)] + [0.49999999999999994e-6, 1e300, 3e10, None]
    values += [float(f"{k}.{k * 7919 % 1000000:06d}5") for k in range(100, 4000)]
    got = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded(F.col("v")).alias("r")).orderBy("i").collect()]
    c = duckdb.connect()
    want = [c.execute("select round(cast(? as double), 6) + 0e0", [v]).fetchone()[0] for v in values]
    assert got == want


def test_equal_loadings_are_ranked_as_in_sql(spark, tmp_path):
    """Branches that differ by a turn of both ends load alike; what is left of it in doubles is the SQL's."""
    for t in TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet") if t != "lineitem" else None
    duckdb.sql(
        f"""copy (select * exclude (place) replace (place as l_linenumber, 22 + 40 * (l_orderkey % 7) as l_partkey, 4 * (l_orderkey % 5) as l_suppkey, (l_orderkey % 11) / 1e2 as l_discount, place % 9 / 1e2 as l_tax)
        from (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as integer) as place from '{SF}/lineitem.parquet') q) to '{tmp_path}/lineitem.parquet'"""
    )
    same_as_sql(catalog.QUERIES["loading_summary"](spark, str(tmp_path)), catalog.ORACLES["loading_summary"], str(tmp_path))
