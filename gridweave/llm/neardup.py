"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Unit vectors are projected on random Gaussian directions and quantised; ``k``
quantised projections make a bucket key, in several tables. Vectors that share a
bucket are first told apart by a code of ``BITS`` signs of further projections: vectors at the
threshold differ in a known share of them, and pairs that differ in more than
that share and five standard deviations (one in millions of those that should be
found) go no further. What is left of a bucket falls into groups; a group that several
tables bring together is kept once. Only then are vectors fetched, once for each group that
a vector is in, and compared exactly. A pair counts in the first table that brings
it together, so that no pair is counted twice and none need be written out.

Vectors at the threshold fall in one cell of a projection with probability p1,
unrelated ones with p2 (both follow from the cell width). k grows with the
logarithm of the row count so that a bucket gathers about ``noise`` unrelated
vectors, and the number of tables as ``-ln(1 - recall) / p1**k``. What is shuffled for
each table is a key, an id and a code, not the vector.

Equal vectors are one class and are hashed once. Buckets of more than ``block``
classes are cut into blocks before rows meet, each pair of blocks a group of its own.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.common import components, forest, mix64, sorted_groups, stored, usable_vectors, vectors_of


def _same_cell(distance: float, width: float) -> float:
    """Probability that two points at this distance share a cell of one projection."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


class Hashes:
    """Keys of unit vectors in every table. Both sides are whole numbers below 2^53 in all
    sums, so keys are the same however a matrix product is ordered."""

    def __init__(self, dim: int, rows: int, threshold: float, recall: float, noise: float = 20, width: float = 2.0, seed: int = 11):
        p1, p2 = _same_cell(math.sqrt(2 - 2 * threshold), width), _same_cell(math.sqrt(2), width)
        self.k = max(1, math.ceil(math.log(max(rows, 1) / noise + 1) / -math.log(p2)))
        self.tables = math.ceil(-math.log(1 - recall) / p1**self.k)
        rng = np.random.default_rng(seed)
        self.a = np.round(rng.normal(size=(dim, self.tables * self.k)) * 1024)
        self.cell = width * 1024 * 2.0**20
        self.b = np.floor(rng.uniform(0, self.cell, self.tables * self.k))

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        cells = np.floor((np.round(unit * 2.0**20) @ self.a + self.b) / self.cell).astype(np.int64).view(np.uint64)
        out = np.zeros((len(unit), self.tables), np.uint64)
        for i in range(self.k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + cells[:, i :: self.k] + np.uint64(i + 1))
        return out.view(np.int64)


BITS = 128


class Codes:
    """Signs of ``BITS`` projections as two longs, and how many may differ at the threshold."""

    def __init__(self, dim: int, threshold: float, seed: int = 13):
        self.a = np.random.default_rng(seed).normal(size=(dim, BITS))
        p = math.acos(threshold) / math.pi
        self.most = math.ceil(BITS * p + 5 * math.sqrt(BITS * p * (1 - p)))

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.a > 0, axis=1).view(np.int64)

    def near(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether rows of p and of q differ in few enough bits, as a matrix."""
        p, q = p.view(np.uint64), q.view(np.uint64)
        apart = sum(np.bitwise_count(p[:, i, None] ^ q[None, :, i]).astype(np.int16) for i in range(p.shape[1]))
        return apart <= self.most


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.95, block: int = 1024) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``.

    Links are pairs of found cosine >= ``threshold``; n_links counts the rows
    linked directly, component_id is the smallest key reachable, kept marks it.
    Vectors that are null, zero or hold null or non-finite parts link with nothing,
    and others with those of their length only; each length has its own hashes and
    is compared in a run of its own. ``recall`` is that of a pair
    just at the threshold; closer pairs are found with more. Keys must be unique
    longs; a row of null key is dropped.
    """
    df = df.where(F.col(key).isNotNull())
    rows = usable_vectors(df, key, vector).withColumn("__d", F.size("__v"))
    lengths = sorted((r["__d"], r.n) for r in rows.groupBy("__d").agg(F.count("*").alias("n")).collect() if r.n > 1)
    lone = df.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    if not lengths:
        return lone
    parts = [_of_length(rows.where(F.col("__d") == d), d, n, key, threshold, recall, block) for d, n in lengths]
    out = df.select(key).join(functools.reduce(DataFrame.unionByName, parts), key, "left")
    return out.select(key, F.coalesce("__n", F.lit(0)).alias("n_links"), F.coalesce("__c", key).alias("component_id"), F.coalesce(F.col("__c") == F.col(key), F.lit(True)).alias("kept"))


def _of_length(rows: DataFrame, d: int, n: int, key: str, threshold: float, recall: float, block: int) -> DataFrame:
    """(key, __n, __c): links and component of ``n`` usable vectors of length ``d``."""
    spark = rows.sparkSession
    classes = rows.groupBy("__h1", "__h2").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("__v").alias("v"))
    said = spark.sparkContext.broadcast((Hashes(d, n, threshold, recall), Codes(d, threshold)))

    def hashed(it):
        hashes, codes = said.value
        for batch in it:
            if batch.num_rows:
                unit = _unit(vectors_of(batch.column("v")))
                keys = hashes(unit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, *map(pa.array, codes(unit).T)], names=[*batch.schema.names, "keys", "c0", "c1"])

    fields = T.StructType([*classes.schema, *T.StructType.fromDDL("keys array<long>, c0 long, c1 long")])
    classes = stored(classes.mapInArrow(hashed, fields), "classes")

    # Only buckets of more than a block need be counted and cut; each holds that many rows, so they are few.
    placed = classes.select("rep", "c0", "c1", F.posexplode("keys").alias("t", "bucket"))
    large = stored(placed.groupBy("t", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block), "large")
    salts = 1 if large.isEmpty() else 16
    if large.count() <= 50_000:
        placed = placed.join(F.broadcast(large), ["t", "bucket"], "left")
    else:
        large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(large, ["t", "bucket", "salt"], "left").drop("salt")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    placed = placed.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    group = ["t", "bucket", "i", "j"]
    placed = placed.repartition(*group).sortWithinPartitions(*group).select(*group, "own", "rep", "c0", "c1")

    def likely(it):
        """Rows of a block that have a partner by their codes: their group's number, table, and side of a pair of blocks (-1: no sides)."""
        codes = said.value[1]
        for table, at in sorted_groups(it, group):
            t, i, j, own, rep, c0, c1 = (table.column(c).to_numpy() for c in ("t", "i", "j", "own", "rep", "c0", "c1"))
            code, out = np.c_[c0, c1], []
            for a, b in zip(at, at[1:]):
                if b - a < 2:
                    continue
                if i[a] == j[a]:
                    x, y = np.nonzero(np.triu(codes.near(code[a:b], code[a:b]), 1))
                    x, y, side = x + a, y + a, np.full(b - a, -1)
                else:
                    p, q = a + np.flatnonzero(own[a:b] == i[a]), a + np.flatnonzero(own[a:b] == j[a])
                    x, y = np.nonzero(codes.near(code[p], code[q]))
                    x, y, side = p[x], q[y], (own[a:b] == j[a]).astype(np.int64)
                if not len(x):
                    continue
                node, root = forest(x, y)
                who = np.r_[node, np.unique(root)]
                root = np.r_[root, np.unique(root)]
                side = side[who - a]
                # A group's number is made of its members and their sides alone.
                _, where = np.unique(root, return_inverse=True)
                number = np.zeros(where.max() + 1, np.uint64)
                np.bitwise_xor.at(number, where, mix64(mix64(rep[who].view(np.uint64)) + (side + 2).astype(np.uint64)))
                out.append((mix64(number)[where].view(np.int64), t[who], side, rep[who]))
            if out:
                g, t, side, rep = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(t.astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(rep)], names=["g", "t", "side", "rep"])

    # The same group of several tables counts in the first.
    found = placed.mapInArrow(likely, "g long, t int, side int, rep long").groupBy("g", "rep").agg(F.min("t").alias("t"), F.first("side").alias("side"))
    found = stored(found, "groups").join(classes.select("rep", "copies", "v"), "rep")
    found = found.repartition("g").sortWithinPartitions("g").select("g", "t", "side", "rep", "copies", "v")

    def compare(it):
        hashes = said.value[0]
        for table, at in sorted_groups(it, ["g"]):
            t, side, rep, copies = (table.column(c).to_numpy() for c in ("t", "side", "rep", "copies"))
            unit = _unit(vectors_of(table.column("v").combine_chunks()))
            left, right = [], []
            for a, b in zip(at, at[1:]):
                if side[a] < 0:
                    x, y = np.nonzero(np.triu(unit[a:b] @ unit[a:b].T >= threshold, 1))
                    x, y = x + a, y + a
                else:
                    p, q = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
                    x, y = np.nonzero(unit[p] @ unit[q].T >= threshold)
                    x, y = p[x], q[y]
                if t[a] and len(x):
                    seen, at_x = np.unique(np.r_[x, y], return_inverse=True)
                    keys = hashes(unit[seen])[:, : t[a]]
                    first = _apart(keys, at_x[: len(x)], at_x[len(x) :])
                    x, y = x[first], y[first]
                left.append(x)
                right.append(y)
            x, y = np.concatenate(left), np.concatenate(right)
            if not len(x):
                continue
            who, where = np.unique(np.r_[rep[x], rep[y]], return_inverse=True)
            links = np.bincount(where, np.r_[copies[y], copies[x]]).astype(np.int64)
            node, root = forest(rep[x], rep[y])
            n, m = len(who), len(node)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[who, node]), pa.array(np.r_[links, root]), pa.array(np.r_[np.zeros(n, bool), np.ones(m, bool)])], names=["u", "x", "edge"])

    found = stored(found.mapInArrow(compare, "u long, x long, edge boolean"), "links")
    links = found.where("not edge").groupBy(F.col("u").alias("rep")).agg(F.sum("x").alias("__links"))
    comp = components(found.where("edge").select("u", F.col("x").alias("v")), "vectors").withColumnRenamed("node", "rep")
    per_class = classes.select("__h1", "__h2", "rep", "copies").join(links, "rep", "left").join(comp, "rep", "left")
    member = rows.select(key, "__h1", "__h2").join(per_class, ["__h1", "__h2"])
    return member.select(key, (F.coalesce("__links", F.lit(0)) + F.col("copies") - 1).alias("__n"), F.coalesce("component", "rep").alias("__c"))


def _apart(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of ``keys`` differ in every column, a slice at a time."""
    parts = [~(keys[a[k : k + 65536]] == keys[b[k : k + 65536]]).any(axis=1) for k in range(0, len(a), 65536)]
    return np.concatenate(parts)
