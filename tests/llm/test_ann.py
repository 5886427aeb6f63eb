import itertools

import numpy as np
from pyspark.sql import functions as F

from gridweave.llm import ann
from gridweave.llm.queries import op10_nearest


def brute(vectors, queries, k=5):
    ids = np.array(sorted(vectors))
    v = np.array([vectors[i] for i in ids], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = v @ v[np.searchsorted(ids, q)]
        order = [j for j in np.lexsort((ids, -s.round(12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_hilbert_neighbours_differ_by_one_step():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        key = ann.hilbert_key(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        path = cells[np.argsort(key)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_on_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = op10_nearest(spark, sf).collect()
    want = brute(rows, [i for i in rows if i % 50 == 0])
    assert len(got) == 5 * len(want)
    hit = sum(r.vec_id in [i for i, _ in want[r.query_id]] for r in got)
    assert hit / len(got) >= 0.9
    for r in got:
        a, b = np.array(rows[r.query_id], float), np.array(rows[r.vec_id], float)
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12


def test_copies_ties_and_edges(spark):
    nan = float("nan")
    rng = np.random.default_rng(0)
    rows = {i: [float(x) for x in rng.normal(size=6)] for i in range(10)} | {50 + i: [1.0, 2.0, 3.0, 4.0, 5.0, 6.0] for i in range(70)}
    rows |= {200: [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]}
    odd = {300: None, 301: [0.0] * 6, 302: [nan] * 6, 303: [None] * 6, 304: [1.0], 350: None}
    df = spark.createDataFrame([(i, v, "x") for i, v in (rows | odd).items()], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, ranges=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == {0, 50, 100, 200}
    assert got[50] == [51, 52, 53, 54, 55] and got[100] == got[200] == [50, 51, 52, 53, 54]
    assert got[0] == [i for i, _ in brute(rows, [0])[0]]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 3)"), F.col("vec_id") == 0).count() == 1


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(3)
    short, long = ({i: [float(x) for x in rng.normal(size=n)] for i in range(a, b)} for a, b, n in ((0, 20, 6), (95, 103, 9)))
    df = spark.createDataFrame([*(short | long | {150: [1.0] * 12}).items()], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, ranges=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in brute(rows, [q])[q]] for q, rows in ((0, short), (100, long))}


def test_very_small_and_large_parts(spark):
    """Exact copies stay in the result whatever their size, and nothing ends the query."""
    rng = np.random.default_rng(7)
    base = {i: rng.normal(size=6) for i in range(30)}
    size = lambda i: (1.0, 1e200, 1e-200, 1e300, 5e-324)[i % 5]
    rows = {i: [float(x) for x in v * size(i)] for i, v in base.items() if i % 5 != 4} | {4: [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0]}
    rows |= {100 + i: rows[i] for i in (0, 1, 2, 3, 4)} | {200 + i: rows[i] for i in (0, 1, 2, 3, 4)} | {150: rows[2], 250: rows[1], 300: rows[3], 350: rows[4]}
    df = spark.createDataFrame([*rows.items()], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, ranges=1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows.items()}
    for q, found in got.items():
        want = brute(unit, [q])[q]
        assert [i for i, _ in found] == [i for i, _ in want]
        assert np.allclose([s for _, s in found], [s for _, s in want], rtol=0, atol=1e-12)
    assert got.keys() == {q for q in rows if q % 50 == 0}
