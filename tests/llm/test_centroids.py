import hashlib

import numpy as np
import pytest

from gridweave.llm import centroids
from gridweave.llm.queries import ORACLES, op12_centroids

from .util import same_as_sql


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert same_as_sql(op12_centroids(spark, path), ORACLES["op12_centroids"], path) == 500


def plainly(rows, k, rounds, scale):
    """(cluster, distance) of each kept row and the centroids, by measuring every distance."""
    x = [[int(np.floor(scale * v)) for v in r[1]] for r in rows]
    order = sorted((hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), v) for r, v in zip(rows, x) if r[0] is not None)
    now = [v for _, v in order[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(now)) for v in x]
        if step < rounds:
            for c in range(len(now)):
                mine = [v for v, f in zip(x, found) if f[1] == c]
                if mine:
                    now[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(f[1], f[0]) for f in found], now


def test_against_all_distances_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    rows = [(i, (base[i % 40] + rng.normal(size=64) * (i % 3)).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), *((200 + i, [0.25] * 64) for i in range(60)), (300, [1e6] * 64), (301, [-1e6] + [0.0] * 63)]
    bad = [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [float("nan")] * 64), (405, [float("inf")] + [0.0] * 63), (406, [None] + [0.0] * 63), (407, [1e300] * 64)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows + bad], "vec_id long, embedding array<double>, cluster int, x int")
    got = centroids.cluster(df.repartition(7)).collect()
    want, now = plainly(rows, 16, 3, 64)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    inertia = [sum(d for c, d in want if c == k) for k in range(16)]
    key = lambda r: tuple((v is None, v) for v in r)
    expected = [(r[0], c, d, inertia[c], sum(inertia), sha[c]) for r, (c, d) in zip(rows, want)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    # Few rows make few centroids, no rows no result.
    few = centroids.cluster(df.where("vec_id in (3, 4)")).collect()
    assert {r.distance for r in few} == {0} and len(few) == 2
    assert centroids.cluster(df.where("vec_id = 400")).collect() == centroids.cluster(df.limit(0)).collect() == []


def test_bounds_leave_out_most_distances():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(3000, 64)) * np.r_[np.full(4, 300.0), np.full(60, 10.0)]).astype(np.int64)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :8]
    c = centroids.Centroids(x[:16], axes)
    best, far, measured = c.nearest(x, *centroids.rotated(x, axes))
    full = ((x[:, None] - x[None, :16]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (far == full.min(axis=1)).all()
    assert measured < 0.2 * full.size
