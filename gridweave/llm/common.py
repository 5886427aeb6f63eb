"""Helpers shared by the corpus operators: shared storage, word hashing, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder; on a
    cluster that is an error, as executors could not read each other's files.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-shared-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_rows_at_once(spark: SparkSession, rows: int = 2000) -> None:
    """Lets Spark hand Python tasks ``rows`` rows at a time, as whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Returns freed memory to the system. Workers outlive their tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freeing(run: Callable) -> Callable:
    """The function of a task, with its memory given back at the end."""

    @functools.wraps(run)
    def wrapped(it):
        yield from run(it)
        give_back()

    return wrapped


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column end to end, and where each row begins; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def batches_of(it: Iterator[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column`` (or one row)."""
    for batch in it:
        texts = batch.column(column)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(size):
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits_of(keys: DataFrame, key: str, most: int = 1 << 25) -> tuple[Column, Callable[[np.ndarray], np.ndarray]]:
    """A hash column of ``key``, and a test of its values that holds for every key in ``keys`` and for few others.

    A bit per hash, at most ``most`` of them (4 MB), whatever the input; as they fill, the
    test only holds for more. It spares what surely has no partner a shuffle; a join
    still decides. Null keys are not told apart from others.
    """
    bits = min(most, max(1 << 10, 1 << (16 * max(1, keys.count()) - 1).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    marked = keys.where(F.col(key).isNotNull()).select(slot.alias("slot")).groupBy(F.expr("cast(slot div 32 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("bits"))
    found = marked.toArrow()
    table = np.zeros(bits // 32, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    told = keys.sparkSession.sparkContext.broadcast(table.astype(np.uint32))
    return slot, lambda at: (told.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def maybe_among(keys: DataFrame, key: str) -> Column:
    """The test of ``bits_of`` as a column; a null key fails."""
    slot, test = bits_of(keys, key)

    def run(slots: pd.Series) -> pd.Series:
        return pd.Series(test(slots.to_numpy(np.int64)))

    return F.pandas_udf(run, "boolean")(slot) & F.col(key).isNotNull()


def components(edges: DataFrame, tag: str = "components", few: int = 1 << 18) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: (u, v) of longs, any direction, repeats and loops allowed.
    Returns (node, component): the smallest node reachable, for every node that
    is not the smallest of its own component. Each step is joins and grouped
    minima, and its result is written to shared storage. Steps end as soon as
    every node has edges to one smaller node at most, which has none itself.

    ``few`` edges (4 MB) or less are not worth a shuffle: one task finds what they connect. Each step
    deals all edges out some six times, which takes minutes where many partitions hold next to nothing.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), tag)

    def at_once(it):
        # Without edges a task has nothing to say.
        if held := list(it):
            table = pa.Table.from_batches(held)
            node, root = forest(table.column("u").to_numpy(), table.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])

    while True:
        if now.count() <= few:
            return stored(now.coalesce(1).mapInArrow(freeing(at_once), "node long, component long"), f"{tag}-found")
        ends = now.select(F.col("u").alias("node"), "v", F.lit(False).alias("up"))
        ends = ends.unionByName(now.select(F.col("v").alias("node"), "v", F.lit(True).alias("up")))
        nodes = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("up").alias("up"))
        nodes = stored(nodes, f"{tag}-nodes")
        if nodes.where("low < high or (low < node and up)").isEmpty():
            return nodes.where("low < node").select("node", F.col("low").alias("component"))
        large = now.join(nodes.select(F.col("node").alias("v"), "low"), "v").select("u", F.col("low").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.distinct(), tag)


def vectors_of(column: pa.Array) -> np.ndarray:
    """A matrix of doubles from a non-empty list column whose lists are equally long."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, __v, __h1, __h2): rows whose vector is not null, zero or with null or non-finite parts."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    return df.where(ok).select(key, v.alias("__v"), F.xxhash64(v).alias("__h1"), F.xxhash64(F.lit(1), v).alias("__h2"))


def sorted_groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables of whole groups, and where each group begins (and the end)."""
    held: list[pa.RecordBatch] = []

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            x = table.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        at = begins(table)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            held = table.slice(at[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        at = begins(table)
        yield table, np.r_[at, len(table)]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of a few edges held in memory: the same components with fewer edges."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    root = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]
