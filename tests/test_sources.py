"""Packed arrays, files of differing columns, and appends that are run again."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.sources import scenarios as io_
from gridweave.streaming.residuals import append_stream


def raw(x, order="C", version=None):
    to = io.BytesIO()
    np.lib.format.write_array(to, np.asarray(x, order=order), version=version)
    return to.getvalue()


def test_packed_arrays_of_every_kind(spark):
    """Types, orders and header versions mixed in a column; short, empty, null and NaN."""
    nan = float("nan")
    rows = [
        ("a", raw(np.array([1, 2, 3], np.int32)), raw(np.array([1 + 2j, 3j, nan], np.complex64)), raw(np.arange(4).reshape(2, 2), "F"), "x"),
        ("b", raw(np.array([1.5, nan]), version=(2, 0)), None, raw(np.arange(4).reshape(2, 2) * (1 + 1j)), "x"),
        ("c", b"", raw(np.array([], complex)), None, "x"),
        ("d", None, raw(np.array([2.0])), None, "x"),
        ("a", raw(np.array([9], np.int8)), None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "scenario_id string, bus_typ binary, u_start binary, Y_matrix binary, index string")
    t = io_.explode_packed(df)
    got = sorted((r.scenario_id, r.bus, repr(r.bus_typ), repr(r.u_start_re), repr(r.u_start_im)) for r in t["bus"].collect())
    want = [("a", 0, "1.0", "1.0", "2.0"), ("a", 0, "9.0", "None", "None"), ("a", 1, "2.0", "0.0", "3.0"), ("a", 2, "3.0", "nan", "0.0"), ("b", 0, "1.5", "None", "None"), ("b", 1, "nan", "None", "None"), ("d", 0, "None", "2.0", "0.0")]
    assert got == want
    flat = io_._explode(df, [], ["Y_matrix"], "at").where("scenario_id in ('a', 'b')").orderBy("scenario_id", "at").collect()
    assert [(r.scenario_id, r.Y_matrix_re, r.Y_matrix_im) for r in flat] == [("a", k, 0.0) for k in range(4)] + [("b", k, float(k)) for k in range(4)]
    assert io_.explode_packed(df.limit(0))["bus"].count() == 0
    with pytest.raises(Exception, match="objects|dtype"):
        io_.explode_packed(spark.createDataFrame([("a", raw(np.array([1.0])).replace(b"<f8", b"|O "))], "scenario_id string, bus_typ binary"))["bus"].collect()


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": [b"a" * 10] * 7 + [b"b" * 50, None, b""]})
    parts = list(io_._some([batch], ["x"], 25))
    assert [p.num_rows for p in parts] == [2, 2, 2, 1, 1, 2] and sum(p.num_rows for p in parts) == 10


def test_one_scan_for_many_paths(spark, tmp_path):
    for k in range(12):
        df = spark.createDataFrame([(k, 5, "g", float(k), 1)], "scenario_id long, bus_number int, gridtype string, U_base double, unknown int")
        (df.drop("U_base") if k % 3 else df).write.parquet(f"{tmp_path}/{k}")
    paths = [f"{tmp_path}/{k}" for k in range(12)]
    df = io_.read_scenarios(spark, paths)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and "unknown" not in df.columns
    assert {r.scenario_id: r.U_base for r in df.collect()} == {k: None if k % 3 else float(k) for k in range(12)}
    # Types that do not merge: a scan for each set of columns, not for each path.
    for k in range(12, 16):
        spark.createDataFrame([(k, "6", "g")], "scenario_id long, bus_number string, gridtype string").write.parquet(f"{tmp_path}/{k}")
    df = io_.read_scenarios(spark, [*paths, *[f"{tmp_path}/{k}" for k in range(12, 16)]])
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 3 and df.count() == 16


def test_profile_of_mixed_files(spark, tmp_path):
    make = lambda rows, cols, name: spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    make([(1, 100.0, b"x"), (2, 10.0, b"x")], "scenario_id long, S_base double, bus_typ binary", "mixed")
    make([(3, 100.0, None), (4, 100.0, None)], "scenario_id long, S_base double, bus_typ binary", "null")
    make([(5, 100.0)], "scenario_id long, S_base double", "short")
    p = io_.profile_dataset(spark, [f"{tmp_path}/{n}" for n in ("mixed", "null", "short")])
    got = {r.file.split("/")[-2]: r for r in p["files"].collect()}
    assert {n: (r.rows, r.S_base, r.needs_rebase, "bus_typ" in r.empty) for n, r in got.items()} == {"mixed": (2, [10.0, 100.0], True, False), "null": (2, [100.0], False, True), "short": (1, [100.0], False, True)}
    assert {r.column for r in p["missing"].collect()} == set(io_.EXPECTED) - {"S_base", "bus_typ"} == set(got["mixed"].empty)
    plan = p["files"]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan") == 1


def test_a_batch_is_written_once(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    path = f"{tmp_path}/out"
    first = io_.append_batches(df, path, "one", 30)
    assert (first.rows, first.total, first.written) == (100, 100, True) and first.rows_per_s > 0
    again = io_.append_batches(df.limit(3), path, "one", 30)
    assert (again.rows, again.total, again.written) == (100, 100, False)
    # A run that failed before its line in the manifest is not seen, and its next run overwrites it.
    df.write.parquet(f"{path}/rows/batch=two")
    assert io_.read_batches(spark, path).count() == 100
    assert io_.append_batches(df.limit(7), path, "two", 30).total == 107
    got = io_.read_batches(spark, path).groupBy("batch").agg(F.count("*").alias("n"), F.sum("k").alias("s")).collect()
    assert {r.batch: r.n for r in got} == {"one": 100, "two": 7}
    assert len(list((tmp_path / "out/rows/batch=one").glob("part-*.parquet"))) >= 4
    assert io_.append_batches(df.limit(0), path, "none", 30).rows == 0 and io_.read_batches(spark, path).count() == 107


def test_a_stream_appends_once(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    append_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert io_.read_batches(spark, f"{tmp_path}/out").count() == 30
    # The stream's checkpoint is lost, and all its batches come again.
    append_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    back = io_.read_batches(spark, f"{tmp_path}/out")
    assert back.count() == back.select("id").distinct().count() == 30
