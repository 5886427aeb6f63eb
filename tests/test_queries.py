import pytest

from gridweave.plans import catalog
from tests.util import same_as_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    same_as_sql(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF)


def test_draws_are_the_same_everywhere(spark):
    """Spark, SQL and plain Python draw bit for bit alike; draws look even and unrelated."""
    import duckdb
    import numpy as np

    from gridweave.functions import numbers as n

    def plain(seed, *keys):
        h = seed % n.PRIME
        for k in (*keys, 0, 0):
            h = (pow(h, 5, n.PRIME) + k) % n.PRIME
        return (h + 0.5) / n.PRIME

    rows = spark.range(-50, 20_000).select("id", n.uniform(7, "id", n.text_key(n.F.lit("gén"))).alias("u"), n.normal(7, "id").alias("z")).orderBy("id").collect()
    sql = f"select {n.uniform_sql(7, 'id', n.text_key_sql(chr(39) + 'gén' + chr(39)))} from range(-50, 20000) t(id) order by id"
    text = 0
    for c in "gén":
        text = (text * 257 + ord(c)) % n.PRIME
    u = np.array([r.u for r in rows])
    assert [r[0] for r in duckdb.sql(sql).fetchall()] == u.tolist() == [plain(7, r.id, text) for r in rows]
    share = np.histogram(u, 20, (0, 1))[0] / len(u)
    assert abs(share - 0.05).max() < 0.008
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03 and abs(np.mean([r.z for r in rows])) < 0.03 and abs(np.std([r.z for r in rows]) - 1) < 0.03


def test_components_in_tasks_and_in_rounds(spark):
    import random

    from gridweave.operators import topology

    rng = random.Random(4)
    bus = [(s, b) for s in range(25) for b in rng.sample(range(-5, 60), rng.randint(1, 40))]
    edges = [(rng.randint(0, 27), rng.randint(-5, 60), rng.randint(-5, 60)) for _ in range(500)] + [(30, 1, 2)]
    there, label = set(bus), {x: x[1] for x in bus}
    for _ in range(60):
        for s, u, v in edges:
            if (s, u) in there and (s, v) in there:
                label[s, u] = label[s, v] = min(label[s, u], label[s, v])
    b = spark.createDataFrame(bus + bus[:9], "scenario_id long, bus int")
    e = spark.createDataFrame(edges + edges[:9], "scenario_id long, u int, v int")
    for local in (100_000, 45, 0):
        got = topology.component_labels(b, e, local)
        assert dict(got.dtypes)["label"] == "int" and {(r.scenario_id, r.bus): r.label for r in got.collect()} == label
        assert got.count() == len(label)
    assert topology.component_labels(b.limit(0), e).count() == 0 and topology.component_labels(b, e.limit(0)).where("label <> bus").count() == 0


def test_only_broken_components_are_labelled_again(spark):
    from gridweave.operators import topology

    bus = spark.createDataFrame([(s, b) for s in (1, 2) for b in range(9)], "scenario_id long, bus long")
    edges = [(s, u, v) for s in (1, 2) for u, v in ((0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (7, 8))]
    gone = {(1, 1, 2), (1, 7, 8)}
    make = lambda rows: spark.createDataFrame(sorted(rows), "scenario_id long, u long, v long")
    before = topology.component_labels(bus, make(edges))
    again = topology.relabel(before, make(gone), make(set(edges) - gone))
    got = {(r.scenario_id, r.bus): r.label for r in again.collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 2, (1, 7): 7, (1, 8): 8}
    every = {(r.scenario_id, r.bus): r.label for r in topology.component_labels(bus, make(set(edges) - gone)).collect()}
    assert {**{(r.scenario_id, r.bus): r.label for r in before.collect()}, **got} == every


def test_expansion_does_not_depend_on_partitioning(spark):
    rows = lambda: sorted(map(tuple, catalog.QUERIES["expand_scenarios"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    many = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_expansion_of_all_levels_by_hand(spark):
    from pyspark.sql import functions as F

    from gridweave.functions.numbers import normal, text_key, uniform
    from gridweave.operators import clean, scenarios
    from gridweave.plans.tables import load

    e = load(spark, SF, "element")
    tight = {r.scenario_id for r in clean.controller_conflicts(e).collect()}
    levels = {r.level: r for r in scenarios.presets(spark).collect()}
    assert len(levels) == 5
    key = ["scenario_id", "draw", "level", "kind", "bus"]
    every = e.crossJoin(spark.range(3).withColumnRenamed("id", "draw")).crossJoin(spark.createDataFrame([(x,) for x in levels], "level string"))
    numbers = ["scenario_id", "draw", text_key("level"), text_key("kind"), "bus"]
    drawn = every.select(*key, "p_mw", "q_mvar", "vm_pu", uniform(42, *numbers[:3]).alias("u"), *[normal(43 + k, *numbers).alias(f"n{k}") for k in range(3)], uniform(46, *numbers).alias("v"))
    want = []
    for r in drawn.collect():
        s = levels[r.level]
        scale = 1.0 if s.scale_lo is None else max(0.05, s.scale_lo + (s.scale_hi - s.scale_lo) * r.u)
        p, q, vm = r.p_mw, r.q_mvar, r.vm_pu
        if r.kind == "load":
            p, q = p * scale * (1 + s.sigma_p * r.n0), q * scale * (1 + s.sigma_q * r.n1)
        elif r.kind == "gen":
            p = max(p * scale, 0.0) * (1 + s.sigma_gen * r.n2)
            vm = vm if r.scenario_id in tight or r.scenario_id % 5 == 0 else s.vm_lo + (s.vm_hi - s.vm_lo) * r.v
        want.append((r.scenario_id, r.draw, r.level, r.kind, r.bus, *(None if x is None else round(x, 6) + 0.0 for x in (p, q, vm))))
    cols = [*key, "p_mw", "q_mvar", "vm_pu"]
    got = [tuple(r) for r in catalog.QUERIES["expand_scenarios"](spark, SF).select(*cols).collect()]
    order = lambda r: tuple(map(repr, r))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert len(got) == len(want) and all(a[:5] == b[:5] for a, b in zip(got, want))
    assert all(x == y or abs(x - y) < 2e-6 for a, b in zip(got, want) for x, y in zip(a[5:], b[5:]))


def test_distinct_bases_of_many_files(spark, monkeypatch, tmp_path):
    from gridweave.plans import scenarios

    buses = scenarios.load(spark, SF, "bus")
    monkeypatch.setattr(scenarios, "load", lambda *a: buses.repartition(5, "vn_kv", "bus"))
    monkeypatch.setattr(scenarios, "_shared", lambda spark: f"file://{tmp_path}/bases")
    got = [tuple(r) for r in catalog.QUERIES["distinct_bases"](spark, SF).collect()]
    assert got == [(1, buses.select("vn_kv").distinct().count())]
    assert len(list((tmp_path / "bases").glob("part-*.parquet"))) > 1
