import hashlib

import numpy as np
import pytest

from gridweave.llm import veccodes
from gridweave.llm.queries import ORACLES, op13_vector_codes

from .util import same_as_sql


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_against_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert same_as_sql(op13_vector_codes(spark, path), ORACLES["op13_vector_codes"], path) == 500


def test_trie_distances_and_sharing():
    rng = np.random.default_rng(1)
    for n, depth, high, stride in [(1, 4, 3, 8), (500, 4, 4, 7), (500, 4, 4, 1), (300, 1, 400, 50), (900, 6, 3, 64)]:
        leaves = np.unique(rng.integers(-high, high, (n, depth)), axis=0)
        entries = rng.integers(-high, high, (11, depth))
        got = np.concatenate([d for _, d in veccodes.trie_distances(leaves, entries, stride)])
        assert (got == ((leaves[:, None] - entries) ** 2).sum(axis=2)).all()
    assert list(veccodes.trie_distances(np.zeros((0, 4), np.int64), entries[:, :4])) == []


def plainly(rows, parts, entries, rounds, scale):
    x = [[int(np.floor(scale * v)) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0], x[i]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
        if step < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                    if mine:
                        books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], sha


@pytest.mark.parametrize("broadcast_rows", [100, 1])
def test_against_all_distances_with_odd_rows(spark, broadcast_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).round(1).tolist(), i % 4 or None) for i in range(120)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 2), (None, rows[9][1], None), *((500 + i, rows[11][1], 3) for i in range(60)), (900, [1e5] * 32, 7)]
    bad = [(400, None, 1), (401, [], 1), (402, [1.0] * 17, 1), (403, [1.0] * 16, 1), (404, [float("nan")] * 32, 1), (405, [float("-inf")] + [0.0] * 31, 1), (406, [None] + [0.0] * 31, 1), (407, [1e300] * 32, 1)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows + bad], "vec_id long, embedding array<double>, label int, error int, code string")
    got = veccodes.encode(df.repartition(5), block=50, broadcast_rows=broadcast_rows).collect()
    code, error, sha = plainly(rows, 16, 64, 2, 256)
    by_label = {r[2]: 0 for r in rows}
    for r, e in zip(rows, error):
        by_label[r[2]] += e
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], c, e, by_label[r[2]], sha) for r, c, e in zip(rows, code, error)), key=key)
    few = veccodes.encode(df.where("vec_id in (1, 2)")).collect()
    assert sorted((r.code, r.error) for r in few) == [("00" * 16, 0), ("01" * 16, 0)]
    assert veccodes.encode(df.limit(0)).collect() == veccodes.encode(df.where("vec_id = 400")).collect() == []
