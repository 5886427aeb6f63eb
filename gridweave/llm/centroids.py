"""Centroid clustering of whole-numbered vectors, with distances filtered in rotated coordinates.

Vectors become integers, floor(``scale`` * x) in every component. Each is stored once
with its leading coordinates along the principal axes of all rows and the norm of
the rest. Between a vector and a centroid, the squared distance of the leading
coordinates plus the squared difference of the norms is never more than the squared
distance, so the centroid of the smallest bound is measured first, in integers, and
only those whose bound does not exceed that are measured too. The bound is lowered
by more than rounding can add, so that assignments are exact.

A round is one pass over the stored rows: every task adds up its vectors by
centroid, Spark adds up the tasks, and the ``k`` centroids alone reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.common import stored, vectors_of

# Whole components below this keep sums of 64 squared differences within 63 bits.
LIMIT = 1 << 27


def whole(vector: str, scale: int) -> Column:
    """``vector`` as integers floor(scale * x); null if it is null, has null or non-finite parts or one that is ``LIMIT`` or more."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * scale))
    # NaN counts as larger than every number, and a null part makes the test null.
    fits = F.forall(F.col(vector).cast("array<double>"), lambda v: F.abs(v * scale) < F.lit(float(LIMIT)))
    return F.when(fits, x.cast("array<int>"))


@dataclass(frozen=True)
class Centroids:
    """Centroids as integers, and as leading coordinates along ``axes`` with the norm of the rest."""

    whole: np.ndarray
    axes: np.ndarray

    def __post_init__(self):
        lead, rest = rotated(self.whole, self.axes)
        object.__setattr__(self, "lead", lead)
        object.__setattr__(self, "rest", rest)

    def nearest(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of every row of integers ``x``: number of the nearest centroid (ties: the smaller), squared distance; and how many distances were measured."""
        bound = ((lead[:, None] - self.lead) ** 2).sum(axis=2) + (rest[:, None] - self.rest) ** 2
        # Rounding moves a bound by far less than this share of the squared lengths.
        room = (lead**2).sum(axis=1)[:, None] + (rest**2)[:, None] + (self.lead**2).sum(axis=1) + self.rest**2
        bound -= 1e-9 * room
        first = bound.argmin(axis=1)
        far = np.full(bound.shape, np.iinfo(np.int64).max)
        row = np.arange(len(x))
        far[row, first] = ((x - self.whole[first]) ** 2).sum(axis=1)
        left = bound <= far[row, first][:, None]
        left[row, first] = False
        i, j = np.nonzero(left)
        for a in range(0, len(i), 65536):
            p, q = i[a : a + 65536], j[a : a + 65536]
            far[p, q] = ((x[p] - self.whole[q]) ** 2).sum(axis=1)
        best = far.argmin(axis=1)
        return best, far[row, best], len(x) + len(i)


def rotated(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the rows along ``axes`` (dim, few), and the norm of what they leave."""
    lead = x @ axes
    return lead, np.sqrt(np.maximum(0.0, (x.astype(np.float64) ** 2).sum(axis=1) - (lead**2).sum(axis=1)))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return vectors_of(batch.column(name)).astype(np.int64)


def principal_axes(rows: DataFrame, dim: int, few: int, column: str = "x") -> np.ndarray:
    """The ``few`` leading principal axes of all ``rows``; dim * (dim + 1) sums reach the driver."""
    names = np.arange(dim * (dim + 1))

    def moments(it):
        total, n = np.zeros(dim * (dim + 1)), 0
        for batch in it:
            if batch.num_rows:
                x = vectors_of(batch.column(column))
                total += np.c_[x.T @ x, x.sum(axis=0)].ravel()
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[names, -1]), pa.array(np.r_[total, n])], names=["at", "sum"])

    sums = rows.select(column).mapInArrow(moments, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    if not sums:
        return np.eye(dim)[:, :few]
    found = {r["at"]: r["sum"] for r in sums}
    m = np.array([found[i] for i in names]).reshape(dim, dim + 1) / found[-1]
    values, vectors = np.linalg.eigh(m[:, :dim] - np.outer(m[:, dim], m[:, dim]))
    return np.ascontiguousarray(vectors[:, np.argsort(-values)[:few]])


def add_up(rows: DataFrame, said, k: int, dim: int) -> dict[int, np.ndarray]:
    """Sums of the vectors nearest to each centroid, and their number last; exact, k * (dim + 1) numbers."""

    def sums(it):
        total = np.zeros((k, dim + 1), np.int64)
        for batch in it:
            if batch.num_rows:
                x = _matrix(batch, "x")
                best, _, _ = said.value.nearest(x, vectors_of(batch.column("lead")), batch.column("rest").to_numpy())
                for c in np.unique(best):
                    total[c] += np.r_[x[best == c].sum(axis=0), (best == c).sum()]
        at = np.flatnonzero(total[:, dim])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, dim + 1)), pa.array(np.tile(np.arange(dim + 1), len(at))), pa.array(total[at].ravel())], names=["c", "at", "sum"])

    out = {}
    for r in rows.mapInArrow(sums, "c long, at long, sum long").groupBy("c", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect():
        out.setdefault(r.c, [0] * (dim + 1))[r["at"]] = int(r["sum"])
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, leading: int = 12) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` finite components.

    The first centroids are the vectors of the ``k`` smallest sha256 of ``1:<key>``
    (ties: the smaller vector; a null key is no start). Other rows are left out, as are those with a
    component of ``LIMIT`` or more after scaling, whose distances a long cannot
    hold. Repeated rows count each; fewer than ``k`` rows make fewer centroids, and no
    rows an empty result. Other columns are not looked at.
    """
    spark = df.sparkSession
    kept = df.select(F.col(key), whole(vector, scale).alias("x")).where(F.size("x") == dim)
    kept = stored(kept, "whole")
    start = kept.where(F.col(key).isNotNull()).select(F.sha2(F.concat(F.lit("1:"), F.col(key).cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    schema = T.StructType([kept.schema[key], *T.StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")])
    if not start:
        return spark.createDataFrame([], schema)
    axes = principal_axes(kept, dim, leading)
    told = spark.sparkContext.broadcast(axes)

    def rotate(it):
        for batch in it:
            if batch.num_rows:
                lead, rest = rotated(_matrix(batch, "x"), told.value)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32)), pa.array(lead.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array(rest)], names=[key, "x", "lead", "rest"])

    rows = stored(kept.mapInArrow(rotate, T.StructType([*kept.schema, *T.StructType.fromDDL("lead array<double>, rest double")])), "rotated")
    now = np.array([r.x for r in start], np.int64)
    for _ in range(rounds):
        for c, total in add_up(rows, spark.sparkContext.broadcast(Centroids(now, axes)), len(now), dim).items():
            now[c] = [s // total[dim] for s in total[:dim]]
    said = spark.sparkContext.broadcast(Centroids(now, axes))

    def assign(it):
        for batch in it:
            if batch.num_rows:
                best, far, _ = said.value.nearest(_matrix(batch, "x"), vectors_of(batch.column("lead")), batch.column("rest").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(best.astype(np.int32)), pa.array(far)], names=[key, "cluster", "distance"])

    assigned = stored(rows.mapInArrow(assign, T.StructType([*schema][:3])), "assigned")
    # One row for each of k centroids.
    sums = {r.cluster: r.d for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    names = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(names), "cluster").select(*schema.names)
