"""Reading and writing scenario tables: packed rows at the edge, long tables inside."""

from __future__ import annotations

import io
import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.numbers import hash_order

# Columns of the packed schema, scalars and arrays per bus and per branch.
SCALARS = ["bus_number", "branch_number", "gridtype", "U_base", "S_base", "converged", "final_misinf", "nr_iterations"]
BUS_REAL = ["bus_typ", "vn_kv"]
BUS_COMPLEX = ["Y_shunt_bus", "u_start", "u_newton", "S_start", "S_newton"]
BRANCH_REAL = ["Branch_f_bus", "Branch_t_bus", "Branch_status", "Is_trafo", "Branch_hv_is_f", "Branch_tau", "Branch_shift_deg", "Branch_n", "Y_C_Lines"]
BRANCH_COMPLEX = ["Branch_y_series_from", "Branch_y_series_to", "Branch_y_series_ft", "Branch_y_shunt_from", "Branch_y_shunt_to", "Y_Lines"]
MATRIX = "Y_matrix"
EXPECTED = [*SCALARS, *BUS_REAL, *BUS_COMPLEX, *BRANCH_REAL, *BRANCH_COMPLEX]
ID_COLUMNS = ["origin_id", "cim_id", "rdf_id", "uuid"]


def read_scenarios(spark: SparkSession, paths: list[str], extra: tuple[str, ...] = ("scenario_id",)) -> DataFrame:
    """All files together, known columns only; columns that a file lacks are null.

    One scan for all paths whose columns agree in type; where they do not, one for
    each set of columns and types there is, whose columns are then widened.
    """
    pick = lambda df: df.select(*[c for c in (*extra, *EXPECTED, MATRIX) if c in df.columns])
    try:
        return pick(spark.read.option("mergeSchema", True).parquet(*paths))
    except (PySparkException, Py4JJavaError):
        by_schema: dict[str, list[str]] = {}
        for p in paths:
            by_schema.setdefault(spark.read.parquet(p).schema.json(), []).append(p)
        if len(by_schema) == 1:
            raise
        out = None
        for group in by_schema.values():
            df = pick(spark.read.parquet(*group))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out


def _header(raw: bytes, known: dict) -> tuple[int, np.dtype, tuple[int, ...], bool]:
    """Where an array's data begin, their type, shape and order, from the header that ``numpy.save`` writes; equal headers are read once."""
    size = 10 + int.from_bytes(raw[8:10], "little") if raw[6] == 1 else 12 + int.from_bytes(raw[8:12], "little")
    head = raw[:size]
    if head not in known:
        to = io.BytesIO(head)
        version = np.lib.format.read_magic(to)
        shape, fortran, dtype = np.lib.format.read_array_header_1_0(to) if version == (1, 0) else np.lib.format.read_array_header_2_0(to)
        if dtype.hasobject:
            raise ValueError("arrays of objects are not read")
        known[head] = (size, dtype, shape, fortran)
    return known[head]


def _decoded(column: pa.Array, kind: type, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Values of all arrays of a column end to end, and how many each row has; null and empty have none."""
    parts, n = [np.zeros(0, kind)], np.zeros(len(column), np.int64)
    for k, raw in enumerate(column.to_pylist()):
        if raw:
            at, dtype, shape, fortran = _header(raw, known)
            x = np.frombuffer(raw, dtype, offset=at)
            parts.append(x.reshape(shape, order="F").ravel() if fortran and len(shape) > 1 else x)
            n[k] = len(x)
    return np.concatenate([x.astype(kind, copy=False) for x in parts]), n


def _some(it, columns: list[str], limit: int = 16 << 20):
    """The same rows in batches of at most ``limit`` packed bytes (or one row)."""
    for batch in it:
        size = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        done, start = np.cumsum(size), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _explode(df: DataFrame, reals: list[str], complexes: list[str], index: str) -> DataFrame:
    """Rows (scenario_id, index, values) of the packed columns there are, many scenarios at a time; a shorter array's missing values are null."""
    reals, complexes = [c for c in reals if c in df.columns], [c for c in complexes if c in df.columns]
    names = [*reals, *(f"{c}_{p}" for c in complexes for p in ("re", "im"))]

    def run(it):
        for batch in _some(it, [*reals, *complexes]):
            known: dict = {}
            found = {c: _decoded(batch.column(c), kind, known) for cs, kind in ((reals, np.float64), (complexes, np.complex128)) for c in cs}
            n = np.max([x for _, x in found.values()], axis=0) if found else np.zeros(batch.num_rows, np.int64)
            start, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            columns = [batch.column("scenario_id").take(pa.array(row)), pa.array(np.arange(len(row)) - start[row])]
            for c in (*reals, *complexes):
                values, have = found[c]
                at = np.repeat(start, have) + np.arange(len(values)) - np.repeat(np.cumsum(have) - have, have)
                none = np.ones(len(row), bool)
                none[at] = False
                for part in (values,) if c in reals else (values.real, values.imag):
                    full = np.zeros(len(row))
                    full[at] = part
                    columns.append(pa.array(full, mask=none))
            yield pa.RecordBatch.from_arrays(columns, names=["scenario_id", index, *names])

    key = df.schema["scenario_id"].dataType.simpleString()
    return df.select("scenario_id", *reals, *complexes).mapInArrow(run, ", ".join([f"scenario_id {key}", f"{index} long", *(f"{n} double" for n in names)]))


def explode_packed(df: DataFrame) -> dict[str, DataFrame]:
    """Long tables ``bus``, ``branch`` and, if stored, ``ybus`` (non-zero entries) of packed rows with scenario_id."""
    out = {"bus": _explode(df, BUS_REAL, BUS_COMPLEX, "bus"), "branch": _explode(df, BRANCH_REAL, BRANCH_COMPLEX, "k")}
    if MATRIX in df.columns:
        flat = _explode(df, [], [MATRIX], "at")
        n = out["bus"].groupBy("scenario_id").agg(F.count("*").alias("n"))
        y = flat.where(f"{MATRIX}_re <> 0 or {MATRIX}_im <> 0").join(n, "scenario_id")
        out["ybus"] = y.select("scenario_id", F.floor(F.col("at") / F.col("n")).alias("i"), (F.col("at") % F.col("n")).alias("j"), F.col(f"{MATRIX}_re").alias("re"), F.col(f"{MATRIX}_im").alias("im"))
    return out


def scenario_file_name(case: str, mode: str, level: str, start: str, unit: str, runs: int) -> str:
    return f"{case}_{mode}_{level}_{start}_{unit}_{runs}runs"


def write_scenarios(df: DataFrame, path: str, save_y_matrix: bool = False, overwrite: bool = False) -> None:
    """Parquet with zstd, by gridtype; the matrix only if asked for; an existing path is an error unless ``overwrite``."""
    if not save_y_matrix and MATRIX in df.columns:
        df = df.drop(MATRIX)
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").partitionBy("gridtype").parquet(path)


@dataclass(frozen=True)
class Appended:
    """What an append did: rows of the batch, rows of all batches, rows a second, and whether it wrote (False: it was there)."""

    rows: int
    total: int
    rows_per_s: float
    written: bool


_MANIFEST = "batch string, rows long, seconds double"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def append_batches(df: DataFrame, path: str, batch: str, rows_per_file: int) -> Appended:
    """Appends ``df`` under ``path`` as ``batch``, in bounded files; a batch that is there already is not written again.

    A batch's rows are written to a folder of their own, then its line to the manifest, which
    is what makes them count (``read_batches``): a run that fails in between
    leaves nothing that is seen, and the next one overwrites it.
    """
    spark = df.sparkSession
    spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{path}/manifest")
    there = _manifest(spark, path).where(F.col("batch") == batch).agg(F.sum("rows"), F.sum("seconds")).first()
    seconds, rows = there[1], there[0]
    if rows is None:
        seen, begin = Observation(), time.monotonic()
        df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows/batch={batch}")
        rows, seconds = seen.get["rows"], time.monotonic() - begin
        line = spark.createDataFrame([(batch, rows, seconds)], _MANIFEST).coalesce(1)
        line.write.mode("append").parquet(f"{path}/manifest")
    total = _manifest(spark, path).agg(F.sum("rows")).first()[0]
    return Appended(rows, total, rows / seconds if seconds else 0.0, there[0] is None)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches in the manifest, with their ``batch``."""
    names = [r.batch for r in _manifest(spark, path).select("batch").distinct().collect()]
    if not names:
        raise ValueError(f"no batches under {path}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={n}" for n in names])
    return rows.withColumn("batch", F.col("batch").cast("string"))


def profile_dataset(spark: SparkSession, paths: str | list[str], by: str = "file") -> dict[str, DataFrame]:
    """``files``: rows, distinct bases and expected columns without a value, by file, with a warning where bases are mixed; ``missing``: expected columns that no file has.

    With ``by="folder"`` the files of a folder, as one job writes them, are one set of data. One pass over all files; of the packed columns only whether they are null is asked.
    """
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    bases, known = [c for c in ("S_base", "U_base") if c in df.columns], [c for c in EXPECTED if c in df.columns]
    place = F.regexp_replace(F.input_file_name(), "/[^/]*$", "") if by == "folder" else F.input_file_name()
    files = df.withColumn("file", place).groupBy("file").agg(
        F.count("*").alias("rows"), *[F.sort_array(F.collect_set(c)).alias(c) for c in bases], *[F.count(c).alias(f"__{c}") for c in known]
    )
    mixed = F.lit(False)
    for c in bases:
        mixed = mixed | (F.size(c) > 1)
    absent = F.array(*[F.lit(c) for c in EXPECTED if c not in known]).cast("array<string>")
    empty = F.array_sort(F.concat(absent, F.array_compact(F.array(*[F.when(F.col(f"__{c}") == 0, c) for c in known])))) if known else F.array_sort(absent)
    files = files.withColumns({"needs_rebase": mixed, "empty": empty}).drop(*[f"__{c}" for c in known])
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "column string")
    return {"files": files, "missing": names([c for c in EXPECTED if c not in known])}


def preview(df: DataFrame, rows: list[int] | None = None, random_rows: int = 0, key: str = "scenario_id", seed: int = 42) -> DataFrame:
    """Chosen rows by key, and ``random_rows`` others in hash order, each once."""
    chosen = df.where(F.col(key).isin(rows or []))
    others = df.where(~F.col(key).isin(rows or [])) if rows else df
    return chosen.unionByName(others.orderBy(hash_order(key, seed), key).limit(random_rows))


def write_history(history: DataFrame, path: str) -> None:
    cols = ["epoch", "split", "loss", "rmse", "rmse_mag", "rmse_ang_deg", "phys"]
    history.select(*cols).orderBy("epoch", "split").write.mode("overwrite").option("header", True).csv(path)


def write_bench(bench: DataFrame, path: str) -> None:
    bench.orderBy("N").write.mode("overwrite").option("header", True).csv(path)


def element_report(table: DataFrame, wanted: list[str], results: DataFrame | None = None, id_col: str = "index", limit: int | None = None) -> DataFrame:
    """Id (the first id column there is), name and wanted columns that exist, next to ``res_`` columns of ``results``."""
    ident = next((c for c in ID_COLUMNS if c in table.columns), id_col)
    cols = [c for c in ("name", *wanted) if c in table.columns]
    out = table.select(F.col(id_col).alias("__i"), F.col(ident).cast("string").alias("id"), *cols)
    if results is not None:
        out = out.join(results.select(F.col(id_col).alias("__i"), *[c for c in results.columns if c.startswith("res_")]), "__i", "left")
    if limit is not None:
        out = out.orderBy("__i").limit(limit)
    return out.drop("__i")


def export_ybus(ybus: DataFrame, bus: DataFrame, switch: DataFrame, path: str) -> None:
    """Matrix entries and bus map as Parquet, switches as CSV, under ``path``."""
    ybus.write.mode("overwrite").parquet(f"{path}/ybus")
    bus.write.mode("overwrite").parquet(f"{path}/bus_map")
    switch.write.mode("overwrite").option("header", True).csv(f"{path}/switch")
