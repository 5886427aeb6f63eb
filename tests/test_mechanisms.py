"""Joins, ranks, samples, grid classes and batches against plain versions, with odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.functions.joins import join_small, rank_within
from gridweave.operators import batching, clean, features, runs, trace, units, validate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_small_joins_are_alike_whatever_the_size(spark, how):
    a = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "k int, v int")
    b = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "k int, t string")
    few, many = join_small(a, b, ["k"], how), join_small(a, b, ["k"], how, most=1)
    assert "BroadcastHashJoin" in plan(few)
    key = lambda r: tuple(map(repr, r))
    assert sorted(few.collect(), key=key) == sorted(many.collect(), key=key) == sorted(a.join(b, ["k"], how).collect(), key=key)


def test_ranks_within_groups(spark):
    rng = random.Random(1)
    rows = [(i, "a" if i % 3 else "b", rng.choice([1.0, 2.0, 2.5, rng.random()])) for i in range(600)] + [(1000, "c", 1.0), (1001, None, 3.0), (1002, None, 2.0), (1003, "c", None)]
    df = spark.createDataFrame(rows, "id long, g string, x double").where("g is not null")
    from pyspark.sql import Window

    want = {r.id: r.r for r in df.where("x is not null").withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("x"))).collect()}
    for parts in (2, 7, 64):
        assert {r.id: r["rank"] for r in rank_within(df.where("x is not null"), ["g"], "x", parts=parts).collect()} == want


def test_bottom_k_moves_no_other_rows(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    few = clean.reservoir_sample(df, 50, "k")
    assert "Exchange" not in plan(few) and "TakeOrderedAndProject" in plan(few)
    assert sorted(few.collect()) == sorted(clean.bottom_k(df, 50, "k", most=10).collect()) and few.count() == 50
    assert clean.reservoir_sample(df, 0, "k").count() == 0 and clean.reservoir_sample(df.limit(3), 5, "k").count() == 3


def grids(spark):
    buses = {1: [(0, 1.0), (1, 2.0)], 2: [(1, 2.0), (0, 1.0)], 3: [(0, 1.0), (1, 2.0)], 4: [(0, -0.0)], 5: [(0, 0.0)], 6: [(0, 1.0), (1, 2.0)], 7: [(0, None)], 8: [(0, None)]}
    branches = {1: [(0, 1, 0.5), (0, 1, 0.25)], 2: [(0, 1, 0.25), (0, 1, 0.5)], 3: [(0, 1, 0.5)], 6: [(0, 1, 0.5), (0, 1, 0.5)]}
    b = spark.createDataFrame([(s, *r, f"n{s}") for s, rows in buses.items() for r in rows], "scenario_id long, bus long, vn double, name string")
    l = spark.createDataFrame([(s, *r) for s, rows in branches.items() for r in rows], "scenario_id long, f_bus long, t_bus long, r double")
    return b.repartition(5), l.repartition(3)


@pytest.mark.parametrize("clash", [False, True])
def test_classes_of_equal_grids(spark, monkeypatch, clash):
    if clash:
        # Every fingerprint the same: whole grids decide.
        monkeypatch.setattr(clean.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    b, l = grids(spark)
    got = {r.scenario_id: (r.grid_id, r.copies) for r in clean.grid_classes(b, l, ["vn"], ["r"]).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 2), 5: (4, 2), 6: (6, 1), 7: (7, 2), 8: (7, 2)}
    kept_b, kept_l, of = clean.share_grid(b, l, ["vn"], ["r"])
    assert {r.grid_id for r in kept_b.collect()} == {1, 3, 4, 6, 7} and kept_b.count() == 8 and kept_l.count() == 5
    back = of.join(kept_l, "grid_id").groupBy("scenario_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    assert {r.scenario_id: r.r for r in back.collect()} == {1: [0.25, 0.5], 2: [0.25, 0.5], 3: [0.5], 6: [0.5, 0.5]}
    assert clean.grid_classes(b.limit(0), l.limit(0), ["vn"], ["r"]).count() == 0


def test_same_grid_names_the_first_difference(spark):
    b = spark.createDataFrame([(s, k, 1 + (s == 2 and k == 1)) for s in range(1, 8) for k in range(2 + (s == 3))], "scenario_id long, bus long, kind long")
    rows = [(s, 0, 1, 1, 0.5 + (s == 4)) for s in range(1, 8) if s != 5] + [(6, 0, 1, 1, 0.5)] + [(7, 1, 0, 1, 0.5)]
    l = spark.createDataFrame([r for r in rows if r[:2] != (7, 0)], "scenario_id long, f_bus long, t_bus long, status long, r double")
    got = {r.scenario_id: r.first_difference for r in validate.check_same_grid(b, l, 1, ["kind"], [], ["status"], ["r"]).collect()}
    assert got == {1: None, 2: "kind", 3: "size", 4: "branch.r", 5: "branch.size", 6: "branch.size", 7: "branch.status"}
    none = {r.scenario_id: r.first_difference for r in validate.check_same_grid(b, l, 5, ["kind"], [], ["status"], ["r"]).collect()}
    assert none[5] is None and none[1] == "branch.size"


def test_batches_are_block_diagonal(spark):
    sizes = spark.createDataFrame([(s, 3, 2) for s in range(10)], "scenario_id long, n long, nl long")
    bus = spark.createDataFrame([(s, b, 10.0 * s + b) for s in range(10) for b in range(3)], "scenario_id long, bus long, v double")
    branch = spark.createDataFrame([(s, f, f + 1, 1.0 * s) for s in range(10) for f in (1, 0)], "scenario_id long, f_bus long, t_bus long, r double")
    y = spark.createDataFrame([(s, i, j, 1.0, 2.0) for s in range(10) for i in range(3) for j in range(3) if i != j], "scenario_id long, i long, j long, re double, im double")
    o = batching.block_offsets(batching.size_bucket_batches(sizes, ["n"], 4), ["batch_no"], "scenario_id")
    made = batching.block_diagonal(o, ["batch_no"], bus, branch, y)
    nodes = {(r.batch_no, r.node): r for r in made["nodes"].collect()}
    for b in range(3):
        count = 3 * (4 if b < 2 else 2)
        assert {n for x, n in nodes if x == b} == set(range(count))
    pointers = {(r.batch_no, r.graph): r for r in made["pointers"].collect()}
    edges = made["edges"].collect()
    assert sorted((e.batch_no, e.edge) for e in edges) == [(b, k) for b in range(3) for k in range(8 if b < 2 else 4)]
    for e in edges:
        assert nodes[e.batch_no, e.src].scenario_id == nodes[e.batch_no, e.dst].scenario_id == e.scenario_id and e.dst == e.src + 1
        p = next(p for (b, _), p in pointers.items() if b == e.batch_no and p.scenario_id == e.scenario_id)
        assert p.node_offset <= e.src < e.dst < p.node_end and p.branch_offset <= e.edge < p.branch_end
    for m in made["matrix"].collect():
        assert nodes[m.batch_no, m.i].scenario_id == nodes[m.batch_no, m.j].scenario_id
    assert made["matrix"].count() == 60


def test_settings_are_flattened_as_logged(spark):
    text = '{"b": "{curly} text", "c": {}, "d": [1, 2, "x", null, true], "e": null, "f": {"g": {"h": [], "i": false, "j": 2.5}}, "k": ""}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "no json"), (4, "[1]"), (5, "{}")], "id int, c string")
    got = {(r.id, r.path): r.value for r in runs.flatten_config(df, "id", "c").collect()}
    want = {"b": "{curly} text", "d": "1,2,x,None,True", "e": "null", "f.g.h": "", "f.g.i": "False", "f.g.j": "2.5", "k": ""}
    assert got == {(1, p): v for p, v in want.items()}
    assert runs.flatten_config(df.limit(0), "id", "c").count() == 0


def test_transition_weights_of_an_asymmetric_matrix(spark):
    """Row sums scale both ends of ``sym``; a stored zero is no neighbour."""
    a = [[0, 2, 0], [8, 0, 1], [4, 0, 0]]
    rows = [(1, i, j, float(v), 0.0) for i, row in enumerate(a) for j, v in enumerate(row) if v or (i, j) == (2, 1)]
    y = spark.createDataFrame([*rows, (1, 0, 0, 5.0, 0.0), (2, 0, 1, 3.0, 4.0)], "scenario_id long, i long, j long, re double, im double")
    got = lambda *o: {(r.scenario_id, r.i, r.j): r.w for r in features.transition_weights(y, *o).collect()}
    deg = [2.0, 9.0, 4.0]
    sym = got("abs", "sym")
    for i in range(3):
        for j in range(3):
            if a[i][j]:
                assert abs(sym[1, i, j] - a[i][j] / (deg[i] * deg[j]) ** 0.5) < 1e-12
    assert abs(sym[2, 0, 1] - 5 / (5**0.5 * 1e-6)) < 1e-3
    binary = got("binary", "row")
    assert binary[1, 2, 1] == 0 and binary[1, 2, 0] == 1 and binary[1, 1, 0] == 0.5


def test_nothing_divides_by_zero(spark):
    bench = spark.createDataFrame([(4, "nr", 0.0, 2), (4, "model", 0.0, 2), (8, "nr", 2.0, 2)], "n int, method string, ms double, cases int")
    got = {(r.n, r.method): (r.cases_per_s, r.speedup) for r in runs.bench_summary(bench, "nr").collect()}
    assert got == {(4, "nr"): (None, None), (4, "model"): (None, None), (8, "nr"): (1000.0, 1.0)}
    t = spark.createDataFrame([("flat", 1, 0, 1.0), ("model", 1, 0, 1.0)], "mode string, scenario_id long, iterations int, converged double")
    assert trace.warmstart_savings(t).first().saved_percent is None
    bus = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0)], "vn_kv double, u_re double, u_im double, s_re double, s_im double, ysh_re double, ysh_im double")
    assert units.buses_to_per_unit(bus, 100.0).first().u_re is None
    y = spark.createDataFrame([(1.0, 1.0, 0.0, 1.0)], "re double, im double, v_i double, v_j double")
    assert units.to_si(y, 1e8).first().re is None


def test_no_slots_of_none(spark):
    df = spark.createDataFrame([(1, 3), (2, 3)], "scenario_id long, n int")
    for strategy in ("cycle", "first", "random"):
        assert batching.fill_to_k(df, 0, strategy).count() == 0


def test_places_the_reference_lacks_differ(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 5, 1.0), (2, 0, 2.0)], "scenario_id long, bus long, v double")
    got = {r.scenario_id: (r.differing, list(r["first"])) for r in validate.compare_vectors(df, df.where("scenario_id = 1 and bus = 0"), "bus", ["v"]).collect()}
    assert got == {1: (1, [5]), 2: (1, [0])}


def test_diagnostics_are_one_grouping(spark):
    e = spark.createDataFrame([("load", 1, 1.0, 0.5), ("load", 0, 2.0, 0.5), ("gen", None, 3.0, None)], "kind string, in_service int, p_mw double, q_mvar double")
    s = spark.createDataFrame([("b", 1), ("b", 0), ("l", 0), ("b", None)], "et string, closed int")
    b = spark.createDataFrame([(110.0,), (110.0,), (20.0,), (None,)], "vn_kv double")
    d = validate.grid_diagnostics(e, s, b)
    assert plan(d).count("Exchange") == 1
    got = {(r.what, r["item"]): (r.n, r.p, r.q) for r in d.collect()}
    none = (None, None)
    assert got == {
        ("switch_closed", "b"): (1, *none), ("switch_open", "b"): (1, *none), ("switch_closed", "l"): (0, *none), ("switch_open", "l"): (1, *none),
        ("out_of_service", "load"): (1, 3.0, 1.0), ("out_of_service", "gen"): (0, 3.0, None), ("kv", "110"): (2, *none), ("kv", "20"): (1, *none), ("kv", None): (1, *none),
    }
