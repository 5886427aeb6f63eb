import numpy as np
import pytest

from gridweave.llm import neardup
from gridweave.llm.queries import op8_near_vectors


def brute(vectors, threshold=0.9):
    ids = sorted(vectors)
    v = np.array([vectors[i] for i in ids], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = v @ v.T >= threshold
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.array([min(label[k], *label[link[k]]) if link[k].any() else label[k] for k in range(len(ids))])
        if (new == label).all():
            return {i: (int(link[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
        label = new


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 24))
    rows = {i: base[i] for i in range(120)}
    rows |= {200 + i: base[i % 7] + rng.normal(size=24) * 0.15 for i in range(90)}
    rows |= {400 + i: base[3] for i in range(40)} | {500 + i: base[3] * (2.0 + i) for i in range(5)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, recall=0.9999, block=block).collect()}
    assert got == brute(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8_near_vectors(spark, sf).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_edges(spark):
    nan = float("nan")
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [None, 1.0], 0), (5, [1.0, 0.0], 0), (6, [1.0, 0.0], 0), (7, [1e300, 1e290], 0), (8, [1.0], 0), (9, [0.0, 1.0], 0), (10, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(df, recall=0.9999).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (0, 8), 9: (0, 9), 10: (0, 10)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_every_length_is_compared(spark):
    rng = np.random.default_rng(2)
    short = {i: rng.normal(size=8) for i in range(30)} | {100 + i: rng.normal(size=8) * 0.01 for i in range(3)}
    short |= {50 + i: short[i % 4] + rng.normal(size=8) * 0.05 for i in range(12)}
    long = {200 + i: rng.normal(size=12) for i in range(3)}
    long |= {210 + i: long[200] * (i + 2) for i in range(3)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in (short | long | {300: np.ones(20)}).items()], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df, recall=0.9999).collect()}
    assert got == brute(short) | brute(long) | {300: (0, 300, True)}


def test_codes_pass_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    codes, base = neardup.Codes(64, 0.9), rng.normal(size=(4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    near = 0.9 * base + np.sqrt(1 - 0.81) * off / np.linalg.norm(off, axis=1, keepdims=True)
    a, b = codes(base), codes(near)
    assert all(codes.near(a[k : k + 1], b[k : k + 1])[0, 0] for k in range(len(a)))
    assert codes.near(a[:1000], b[2000:3000]).mean() < 2e-3


def test_vectors_are_sent_once_a_group(spark, monkeypatch):
    """Of rows with no near partner nothing but keys and codes is shuffled; of a pair, its vectors once, however many tables bring it together."""
    rng = np.random.default_rng(6)
    rows = {i: rng.normal(size=64) for i in range(400)}
    rows |= {1000 + i: rows[i] + rng.normal(size=64) * 0.01 for i in range(50)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, embedding array<double>")
    sent = {}
    keep = neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda d, tag: sent.setdefault(tag, keep(d, tag)))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert neardup.Hashes(64, 450, 0.9, 0.95).tables > 3 and sent["groups"].count() <= 150
