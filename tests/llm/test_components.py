import numpy as np
import pytest

from gridweave.llm.common import components, forest


def plain(edges):
    """Smallest node reachable, of every node that is not its own."""
    root = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
    return {n: r for n, r in root.items() if n != r}


rng = np.random.default_rng(5)
GRAPHS = {
    "empty": [],
    "loops only": [(3, 3), (4, 4)],
    "stars, repeated": [(1, 9), (9, 1), (1, 8), (1, 8), (2, 7)],
    "a path": [(i, i + 1) for i in range(40)],
    "a path of mixed order": list(zip(rng.permutation(60).tolist(), rng.permutation(60).tolist())),
    "a root below a star": [(5, 6), (5, 7), (0, 7)],
    "many": rng.integers(0, 400, (300, 2)).tolist(),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = [tuple(e) for e in GRAPHS[name]]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain(edges)


@pytest.mark.parametrize("name", GRAPHS)
def test_components_of_many_edges_in_steps(spark, name):
    edges = [tuple(e) for e in GRAPHS[name]]
    found = components(spark.createDataFrame(edges, "u long, v long"), few=0).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain(edges)


def test_few_edges_need_no_steps(spark):
    """The jobs of a small path do not grow with its length."""
    edges, sc = [(i, i + 1) for i in range(300)], spark.sparkContext
    sc.setJobGroup("few edges", "")
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    jobs = sc.statusTracker().getJobIdsForGroup("few edges")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.component for r in found} == {i: 0 for i in range(1, 301)}
    assert 0 < len(jobs) <= 6


@pytest.mark.parametrize("name", GRAPHS)
def test_forest(name):
    edges = np.array(GRAPHS[name], np.int64).reshape(-1, 2)
    node, root = forest(edges[:, 0], edges[:, 1])
    assert dict(zip(node.tolist(), root.tolist())) == plain(edges.tolist())
