"""Approximate nearest neighbours along shifted Hilbert curves.

Every vector is scaled to length one, projected on a few random orthogonal
directions, shifted and put on a grid; its place on the Hilbert curve through that
grid is its key. Several curves (other directions and shifts) order the rows in
several ways. Each order is cut into ranges of about equal row counts; a query
looks through its own range and the two next to it on every curve, and what it
finds there is merged and ranked by exact cosines on the original vectors.

Ranges are shares of the table, so recall does not fall as rows are added. A
range's rows and its queries are compared in blocks of bounded size.
Equal vectors are one class: searched once, and widened at the end.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import sorted_groups, stored, usable_vectors, vectors_of

# Cosines that agree to so many decimals tie; sums of doubles differ beyond that by their order.
DIGITS = 12


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of grid ``cells`` (n, dims; 0 to 2**bits - 1) on the Hilbert curve; dims * bits < 64.

    Works down from the highest bit, undoing at each level the reflection and
    exchange of axes of the sub-cube that the point lies in, then takes the Gray
    code's rank.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(dims):
            inside = (x[axis] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


class Curves:
    """Keys of vectors on ``curves`` Hilbert curves."""

    def __init__(self, dim: int, curves: int, dims: int = 8, bits: int = 4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bits, dims = bits, min(dims, dim)
        self.axes = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :dims] for _ in range(curves)]
        # Four standard deviations of a projected unit vector to either side, and up to one cell of shift.
        self.scale, self.shift = math.sqrt(dim), rng.uniform(0, 1, (curves, dims))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        top = 1 << self.bits
        out = np.empty((len(v), len(self.axes)), np.int64)
        for k, axes in enumerate(self.axes):
            cells = np.floor((v @ axes * self.scale + 4) / 8 * (top - 1) + self.shift[k])
            out[:, k] = hilbert_key(np.clip(cells, 0, top - 1).astype(np.int64), self.bits)
        return out


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of every row of q with every row of v, safe for very large and small parts."""
    q, v = q / np.abs(q).max(axis=1, keepdims=True), v / np.abs(v).max(axis=1, keepdims=True)
    return (q @ v.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1)))


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = 18, ranges: int = 48, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every query row, by cosine.

    Ties go to the smaller key. Candidates are all rows but the query's own.
    Vectors that are null, zero or hold null or non-finite parts take no part; the
    others are compared with those of their length, each length with its own curves
    and in a run of its own. Keys must be unique longs; a row of null key
    is dropped. Fewer rows than ``k`` give as many results as there are.
    """
    spark = df.sparkSession
    df = df.where(F.col(key).isNotNull())
    rows = usable_vectors(df.withColumn("__q", is_query), key, vector).withColumn("__d", F.size("__v"))
    queries = usable_vectors(df.where(is_query), key, vector).select(key, "__h1", "__h2", F.size("__v").alias("__d"))
    lengths = sorted(r["__d"] for r in rows.groupBy("__d").agg(F.count("*").alias("n")).collect() if r.n > 1)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    return functools.reduce(DataFrame.unionByName, [_of_length(rows.where(F.col("__d") == d), queries.where(F.col("__d") == d), d, k, key, curves, ranges, block) for d in lengths])


def _of_length(rows: DataFrame, queries: DataFrame, d: int, k: int, key: str, curves: int, ranges: int, block: int) -> DataFrame:
    """The results of ``nearest`` for usable vectors of length ``d``."""
    spark = rows.sparkSession
    # The k + 1 smallest keys of each class, first within salts so that a large class is no single task's work.
    salted = Window.partitionBy("__h1", "__h2", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key)
    whole = Window.partitionBy("__h1", "__h2").orderBy(key)
    few = rows.select(key, "__h1", "__h2").withColumn("__r", F.row_number().over(salted)).where(F.col("__r") <= k + 1)
    few = few.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= k + 1)
    members = few.groupBy("__h1", "__h2").agg(F.sort_array(F.collect_list(key)).alias("members"))
    asked = queries.select("__h1", "__h2").distinct().withColumn("asked", F.lit(True))
    classes = rows.groupBy("__h1", "__h2").agg(F.min(key).alias("rep"), F.first("__v").alias("v"))
    classes = stored(classes.join(members, ["__h1", "__h2"]).join(asked, ["__h1", "__h2"], "left"), "classes")

    say = spark.sparkContext.broadcast(Curves(d, curves))

    def keyed(it):
        for batch in it:
            if batch.num_rows:
                keys = say.value(vectors_of(batch.column("v")))
                n, c = keys.shape
                who = pa.array(np.repeat(np.arange(n), c))
                cols = [pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(keys.ravel()), *(batch.column(x).take(who) for x in ("rep", "asked", "v"))]
                yield pa.RecordBatch.from_arrays(cols, names=["curve", "place", "rep", "asked", "v"])

    on_curves = classes.select("rep", "asked", "v").mapInArrow(keyed, "curve int, place long, rep long, asked boolean, v array<double>")
    # Range bounds: curves * (ranges - 1) numbers, whatever the input.
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)] or [F.lit(1.0)])
    bounds = {r.curve: np.unique(np.array(r.b or [], np.int64)) for r in on_curves.groupBy("curve").agg(F.percentile_approx("place", shares, F.lit(20_000)).alias("b")).collect()}
    bounds = [bounds[c] for c in range(curves)]

    def range_of(curve: pd.Series, place: pd.Series) -> pd.Series:
        out, c, p = np.zeros(len(curve), np.int32), curve.to_numpy(), place.to_numpy()
        for k in np.unique(c):
            out[c == k] = np.searchsorted(bounds[k], p[c == k], side="right")
        return pd.Series(out)

    on_curves = on_curves.withColumn("range", F.pandas_udf(range_of, "int")("curve", "place"))
    counted = on_curves.groupBy("curve", "range").agg(F.count("*").alias("n"), F.count("asked").alias("q")).collect()
    size = {(r.curve, r["range"]): r for r in counted}
    near = lambda c, r: sum(size[c, x].q for x in (r - 1, r, r + 1) if (c, x) in size)
    plan = [(c, r, max(1, math.ceil(s.n / block)), max(1, math.ceil(near(c, r) / block))) for (c, r), s in size.items() if near(c, r)]
    plan = F.broadcast(spark.createDataFrame(plan, "curve int, range int, nd int, nq int"))
    data = on_curves.join(plan, ["curve", "range"])
    data = data.select("curve", "range", F.pmod(F.hash("rep"), "nd").alias("d"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("q"), F.lit(False).alias("ask"), "rep", "v")
    ask = on_curves.where("asked").withColumn("range", F.explode(F.array(F.col("range") - 1, F.col("range"), F.col("range") + 1))).join(plan, ["curve", "range"])
    ask = ask.select("curve", "range", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)).alias("d"), F.pmod(F.hash("rep"), "nq").alias("q"), F.lit(True).alias("ask"), "rep", "v")
    group = ["curve", "range", "d", "q"]
    blocks = data.unionByName(ask).repartition(*group).sortWithinPartitions(*group)

    def compare(it):
        for table, at in sorted_groups(it, group):
            asks, rep = table.column("ask").to_numpy(), table.column("rep").to_numpy()
            v = vectors_of(table.column("v").combine_chunks())
            for a, b in zip(at, at[1:]):
                q, d = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if not len(q) or not len(d):
                    continue
                s = _cosines(v[q], v[d])
                s[rep[q][:, None] == rep[d]] = -np.inf
                keep = min(k, len(d))
                # Everything as near as the k-th stays in, so that ties are settled by key later.
                near = np.round(s, DIGITS)
                floor = -np.partition(-near, keep - 1, axis=1)[:, keep - 1]
                x, y = np.nonzero((near >= floor[:, None]) & np.isfinite(s))
                order = np.lexsort((rep[d][y], -near[x, y], x))
                x, y = x[order], y[order]
                rank = np.arange(len(x)) - np.searchsorted(x, x)
                x, y = x[rank < k], y[rank < k]
                yield pa.RecordBatch.from_arrays([pa.array(rep[q][x]), pa.array(rep[d][y]), pa.array(s[x, y])], names=["rep", "found", "score"])

    found = blocks.mapInArrow(compare, "rep long, found long, score double").groupBy("rep", "found").agg(F.max("score").alias("score"))
    best = Window.partitionBy("rep").orderBy(-F.round("score", DIGITS), "found")
    found = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).drop("__r")
    # Of equal vectors as of others: parts go by the largest, so that no square is lost or overflows.
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    own = classes.where("asked").select("rep", F.col("rep").alias("found"), norm(scaled).alias("n")).select("rep", "found", (F.col("n") / (F.sqrt("n") * F.sqrt("n"))).alias("score"))
    found = found.unionByName(own).join(classes.select(F.col("rep").alias("found"), "members"), "found")
    wide = found.select("rep", "score", F.explode("members").alias("vec_id"))
    # A query has at most k of its own class and k classes of k + 1 members each to choose from.
    wide = wide.withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy(-F.round("score", DIGITS), "vec_id"))).where(F.col("__r") <= k + 1)
    lists = wide.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct((-F.round("score", DIGITS)).alias("near"), "vec_id", "score"))).alias("best"))
    per_class = classes.where("asked").select("__h1", "__h2", "rep").join(lists, "rep")
    out = queries.join(per_class, ["__h1", "__h2"])
    kept = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col(key)), 1, k)
    out = out.select(F.col(key).alias("query_id"), F.posexplode(kept).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
