"""Vector codes: every part of a vector by the number of its nearest codebook entry.

Vectors become integers, floor(``scale`` * x), and are cut into equal parts. The
distinct parts of a block of vectors, in lexicographic order, are the leaves of a trie
whose edges are components. It is walked depth first: each node has the squared
distances to all entries added up over the components so far, made once from its
parent's and shared by all parts below it. A leaf takes the nearest entry, with the
weight of the vectors that have this part. The walk goes in strides of some leaves
that share a path from the root; what stays open between strides is that path.

Assignments need no shuffle, as codebooks are small: tasks add up their vectors by
entry, Spark adds up the tasks, and parts * entries sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.centroids import whole
from gridweave.llm.common import stored, vectors_of

STRIDE = 2048


def trie_distances(leaves: np.ndarray, entries: np.ndarray, stride: int = STRIDE) -> Iterator[tuple[int, np.ndarray]]:
    """(first leaf, squared distances to all ``entries``) for strides of sorted distinct ``leaves`` (n, depth), depth first."""
    depth = leaves.shape[1]
    # How many components a leaf shares with the one before it.
    shared = np.r_[0, (leaves[1:] == leaves[:-1]).cumprod(axis=1).sum(axis=1)] if len(leaves) else np.zeros(0, np.int64)
    path: list[np.ndarray | None] = [None] * depth
    for a in range(0, len(leaves), stride):
        part, same = leaves[a : a + stride], shared[a : a + stride]
        above = np.zeros((1, len(entries)), np.int64)
        parent = np.zeros(len(part), np.int64)
        for d in range(depth):
            new = same <= d
            # Before the first new node of this depth, leaves hang on the one left open by the stride before.
            open_ = not new[0]
            node = np.cumsum(new) - (0 if open_ else 1)
            at = np.flatnonzero(new)
            made = above[parent[at]] + (part[at, d, None] - entries[:, d]) ** 2
            above = np.concatenate([path[d], made]) if open_ else made
            path[d] = above[-1:].copy()
            parent = node
        yield a, above[parent]


class Codebooks:
    """Entries (parts, entries, width) as integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def assign(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of every part position: position, distinct parts, how many vectors have each, nearest entry, its distance, which part a vector has."""
        parts, _, width = self.entries.shape
        for p in range(parts):
            mine = x[:, p * width : (p + 1) * width]
            order = np.lexsort(mine.T[::-1])
            mine = mine[order]
            first = np.r_[True, (mine[1:] != mine[:-1]).any(axis=1)]
            leaves = mine[first]
            which = np.empty(len(x), np.int64)
            which[order] = np.cumsum(first) - 1
            code, far = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
            for a, d in trie_distances(leaves, self.entries[p]):
                best = d.argmin(axis=1)
                code[a : a + len(d)], far[a : a + len(d)] = best, d[np.arange(len(d)), best]
            yield p, leaves, np.bincount(which, minlength=len(leaves)), code, far, which


def _blocks(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows in blocks of about ``rows``: longer blocks share more of a trie."""
    held, n = [], 0
    for batch in it:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            held.append(part)
            n += part.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(table: pa.Table) -> np.ndarray:
    return vectors_of(table.column("x").combine_chunks()).astype(np.int64)


def add_up(rows: DataFrame, said, block: int) -> list:
    """(part, entry, at, sum): the vectors' parts added up by nearest entry, and their number at -1."""

    def sums(it):
        parts, k, width = said.value.entries.shape
        total = np.zeros((parts, k, width + 1), np.int64)
        for table in _blocks(it, block):
            for p, leaves, n, code, _, _ in said.value.assign(_matrix(table)):
                order = np.argsort(code, kind="stable")
                used, at = np.unique(code[order], return_index=True)
                total[p, used] += np.add.reduceat(np.c_[leaves * n[:, None], n][order], at)
        p, e, at = np.nonzero(np.broadcast_to(total[:, :, width:] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(np.where(at == width, -1, at)), pa.array(total[p, e, at])], names=["p", "e", "at", "sum"])

    return rows.select("x").mapInArrow(sums, "p long, e long, at long, sum long").groupBy("p", "e", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()


def encode(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, block: int = 32_768, broadcast_rows: int = 50_000
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that can be cut into ``parts``.

    Codebooks start as the parts of the ``entries`` smallest keys (ties: the smaller
    vector; a null key comes last). Rows whose vector is null or has null or non-finite components are
    left out, and those whose scaled components or their squared distances would not fit whole numbers
    (``centroids.LIMIT``). Codebooks need vectors of one length: the commonest that
    ``parts`` divides (ties: the shorter); vectors of another length are left out too. Repeated rows
    count each; no rows make an empty result. ``label_error`` adds up the errors
    of equal labels, nulls together; sums of up to ``broadcast_rows`` labels are
    broadcast, more are joined by a salted shuffle.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    spark = df.sparkSession
    kept = df.select(F.col(key), F.col(label).alias("__label"), whole(vector, scale).alias("x")).where(F.size("x") > 0).where(F.size("x") % parts == 0)
    kept = stored(kept, "whole")
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("code string, error long, label_error long, codebooks_sha256 string")])
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0].d
    kept = kept.where(F.size("x") == dim)
    start = np.array([r.x for r in kept.orderBy(F.col(key).asc_nulls_last(), "x").select("x").limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found: dict = {}
        for r in add_up(kept, spark.sparkContext.broadcast(Codebooks(books)), block):
            found.setdefault((r.p, r.e), {})[r["at"]] = int(r["sum"])
        for (p, e), total in found.items():
            books[p, e] = [total[i] // total[-1] for i in range(books.shape[2])]
    said = spark.sparkContext.broadcast(Codebooks(books))

    def codes(it):
        for table in _blocks(it, block):
            x = _matrix(table)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, _, _, best, far, which in said.value.assign(x):
                code[:, p] = best[which]
                error += far[which]
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([table.column(key).combine_chunks(), table.column("__label").combine_chunks(), pa.array(text), pa.array(error)], names=[key, "__label", "code", "error"])

    done = stored(kept.mapInArrow(codes, T.StructType([df.schema[key], T.StructField("__label", df.schema[label].dataType), *T.StructType.fromDDL("code string, error long")])), "codes")
    sums = stored(done.groupBy("__label").agg(F.sum("error").alias("label_error")), "labels")
    sums = sums.withColumnRenamed("__label", "__of")
    same = F.col("__label").eqNullSafe(F.col("__of"))
    if sums.count() <= broadcast_rows:
        out = done.join(F.broadcast(sums), same)
    else:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sums = sums.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = done.withColumn("__s", F.pmod(F.xxhash64(key, "code"), F.lit(salts)).cast("int")).join(sums, same & (F.col("__s") == F.col("__t")))
    text = ",".join(map(str, books.ravel().tolist()))
    return out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest())).select(*schema.names)
