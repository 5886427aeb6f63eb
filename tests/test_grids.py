"""Small hand-made grids and identities."""

import cmath
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, normalize_complex
from gridweave.operators import batching, features, residual, runs, scenarios, topology, trace, units, validate, voltage, ybus
from gridweave.sources import scenarios as io_

BRANCH = "scenario_id long, f_bus long, t_bus long, status long, r double, x double, b double, tau double, shift_deg double"


def y_of(df):
    return {(r.i, r.j): complex(r.re, r.im) for r in df.collect()}


def test_line_and_transformer(spark):
    rows = [(1, 0, 1, 1, 0.01, 0.1, 0.02, 1.0, 0.0), (1, 1, 2, 1, 0.02, 0.08, 0.0, 0.95, 30.0), (1, 0, 2, 0, 0.1, 0.1, 0.0, 1.0, 0.0)]
    y = y_of(ybus.build_ybus(units.branch_admittance(spark.createDataFrame(rows, BRANCH))))
    a, t = 1 / complex(0.01, 0.1), 1 / complex(0.02, 0.08)
    tap = cmath.rect(0.95, math.radians(30))
    want = {(0, 0): a + 0.01j, (0, 1): -a, (1, 0): -a, (1, 1): a + 0.01j + t / abs(tap) ** 2, (1, 2): -t / tap.conjugate(), (2, 1): -t / tap, (2, 2): t}
    assert y.keys() == want.keys() and all(abs(y[k] - want[k]) < 1e-12 for k in want)
    assert abs(y[1, 2] - y[2, 1]) > 1


def test_row_sums_are_shunts_and_residual_is_zero(spark):
    rows = [(7, i, (i + 1) % 6, 1, 0.01 * (i + 1), 0.1, 0.02, 1.0, 0.0) for i in range(6)]
    y = ybus.build_ybus(units.branch_admittance(spark.createDataFrame(rows, BRANCH)))
    sums = y.groupBy("i").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect()
    assert all(abs(r.re) < 1e-12 and abs(r.im - 0.02) < 1e-12 for r in sums)
    m = y_of(y)
    v = [cmath.rect(1 + 0.01 * i, 0.02 * i) for i in range(6)]
    s = [v[i] * sum(m.get((i, j), 0) * v[j] for j in range(6)).conjugate() for i in range(6)]
    bus = spark.createDataFrame([(7, i, 1 if i == 0 else 3, s[i].real, s[i].imag, v[i].real, v[i].imag) for i in range(6)], "scenario_id long, bus long, bus_type long, p_set double, q_set double, u_re double, u_im double")
    inf = residual.residual_inf(residual.power_residual(bus, y)).first()
    assert inf.dp_inf < 1e-12 and inf.dq_inf < 1e-12
    same = ybus.aggregate_ybus(y, bus.select("scenario_id", "bus", F.col("bus").alias("node")))
    assert ybus.compare_ybus(y, same).first().max_diff < 1e-15


def test_zero_impedance_and_tap(spark):
    df = units.branch_admittance(spark.createDataFrame([(1, 0, 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0)], BRANCH)).first()
    assert df.y_from_re == 0 and df.y_ft_im == 0 and df.tau == 1


def test_islands_and_switches(spark):
    bus = spark.createDataFrame([(1, b, 1 if b == 0 else 3) for b in range(4)] + [(2, 0, 1)], "scenario_id long, bus long, bus_type long")
    branch = spark.createDataFrame([(1, 0, 1, 1), (1, 2, 3, 1), (1, 1, 2, 0)], "scenario_id long, f_bus long, t_bus long, status long")
    switch = spark.createDataFrame([(1, 0, 1, "b", 1), (1, 1, 2, "b", 1), (1, 2, 3, "b", 0)], "scenario_id long, bus long, element long, et string, closed long")
    assert {(r.scenario_id, r.connected) for r in topology.reachable_from_slack(bus, branch).collect()} == {(1, 0), (2, 1)}
    assert {(r.scenario_id, r.bus) for r in topology.unsupplied_buses(bus, branch).collect()} == {(1, 2), (1, 3)}
    assert topology.unsupplied_buses(bus, branch, switch).count() == 0
    assert {(r.bus, r.node) for r in topology.fuse_switched_buses(bus, switch).where("scenario_id = 1").collect()} == {(0, 0), (1, 0), (2, 0), (3, 1)}


@pytest.mark.parametrize("text,want", [("1+2i", 1 + 2j), ("1-2j", 1 - 2j), ("(3, -4)", 3 - 4j), ("[1.5,2e1]", 1.5 + 20j), ('{"real": 1, "imag": 2}', 1 + 2j), ('{"re": 1, "im": -2}', 1 - 2j), ("7", 7), ("2j", 2j), ("(1e-3+2.5j)", 1e-3 + 2.5j), ("x", None)])
def test_complex_spellings(spark, text, want):
    z = normalize_complex("t")
    r = spark.createDataFrame([(text,)], "t string").select(z.re.alias("re"), z.im.alias("im")).first()
    assert (None if r.re is None else complex(r.re, r.im)) == want


def test_packed_round_trip(spark):
    def raw(a):
        to = io.BytesIO()
        np.save(to, a)
        return bytearray(to.getvalue())

    rows = [(1, raw(np.array([1, 3], np.int32)), raw(np.array([1 + 2j, 3], np.complex64)), raw(np.array([0], np.int32)), raw(np.array([1, 2j, 0, 4]).reshape(2, 2))), (2, raw(np.zeros(0)), None, None, None)]
    t = io_.explode_packed(spark.createDataFrame(rows, "scenario_id long, bus_typ binary, u_start binary, Branch_f_bus binary, Y_matrix binary"))
    assert [(r.scenario_id, r.bus, r.bus_typ, r.u_start_re, r.u_start_im) for r in t["bus"].orderBy("bus").collect()] == [(1, 0, 1.0, 1.0, 2.0), (1, 1, 3.0, 3.0, 0.0)]
    assert t["branch"].count() == 1
    assert {(r.i, r.j, r.re, r.im) for r in t["ybus"].collect()} == {(0, 0, 1.0, 0.0), (0, 1, 0.0, 2.0), (1, 1, 4.0, 0.0)}


def test_traces(spark):
    made = {1: [8, 7, 6.5, 6, 5.5, 5, 4.5, 3.0], 2: [5.0] * 8, 3: [1.0, 2.0, 4.0, 8.0], 4: [5, 1, 1e-4], 5: [3.0], 6: [4, 5, 2, 3, 2.5, 3.5, 4.5]}
    rows = [(s, i, float(v), 1e-9) for s, t in made.items() for i, v in enumerate(t)]
    df = spark.createDataFrame(rows, "scenario_id long, iter long, misinf double, step double")
    every = spark.createDataFrame([(s,) for s in range(1, 8)], "scenario_id long")
    got = {r.scenario_id: r.reason for r in trace.classify_nonconvergence(df, every).collect()}
    assert got == {1: "slow_convergence", 2: "stagnation", 3: "divergence", 4: "near_convergence_not_passing_step", 5: "stagnation", 6: "divergence", 7: "no_progress_data"}
    assert trace.classify_nonconvergence(df.limit(0)).count() == 0


def test_batches_ignore_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias("scenario_id"), (F.col("id") % 3).alias("n"))
    a = batching.size_bucket_batches(df, ["n"], 7).collect()
    b = batching.size_bucket_batches(df.repartition(9), ["n"], 7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert {r.n for r in a} == {0, 1, 2} and max(r.pos for r in a) == 6
    cut = batching.size_bucket_batches(df, ["n"], 7, drop_last=True)
    assert cut.count() == 3 * 7 * 47


def test_random_grids_hold_together(spark):
    bus, pair = scenarios.random_grids(spark, {"mv": (3, 8, 20.0), "hv": (1, 4, 110.0)}, 20)
    linked = pair.where("connected = 1").select("scenario_id", F.col("i").alias("f_bus"), F.col("j").alias("t_bus"), F.lit(1).alias("status"))
    assert topology.unsupplied_buses(bus, linked).count() == 0
    again = scenarios.random_grids(spark, {"mv": (3, 8, 20.0), "hv": (1, 4, 110.0)}, 20)[1]
    assert pair.exceptAll(again).count() == 0


def test_small_results(spark):
    r = spark.createDataFrame([(1, "a", 1.0, 3.0), (2, "a", 2.0, 2.0), (3, "a", 3.0, 1.0), (4, "a", 3.0, 3.0), (5, "a", 1.0, 4.0)], "run_id long, config string, rmse_mag double, rmse_ang_deg double")
    assert {x.run_id for x in runs.pareto_front(r).collect()} == {1, 2, 3, 5}
    v = spark.createDataFrame([("p", 1, 0, 1.0, 2 * math.pi)], "run_id string, scenario_id long, bus long, vm double, va double")
    t = spark.createDataFrame([("t", 1, 0, 1.0, 0.0)], v.schema)
    assert abs(voltage.voltage_rmse(voltage.pred_vs_truth(v, t), "run_id").first().rmse_ang_deg) < 1e-9
    w = features.transition_weights(spark.createDataFrame([(1, 0, 1, 3.0, 4.0), (1, 0, 0, 1.0, 0.0)], "scenario_id long, i long, j long, re double, im double")).collect()
    assert len(w) == 1 and abs(w[0].w - 1) < 1e-9
    one = spark.createDataFrame([(1, 0, 3, 1.0)], "scenario_id long, bus long, bus_type long, vm double")
    assert validate.bus_type_counts(one).first().asDict() == {"scenario_id": 1, "slack": 0, "pv": 0, "pq": 1}
    z = Cx.of(3.0, 4.0)
    assert spark.range(1).select((z / z).re, z.abs()).first()[:] == (1.0, 5.0)


def test_exact_quantiles_of_many_rows_narrow_to_one(spark):
    import math

    import numpy as np

    from gridweave.functions.numbers import exact_quantiles

    wide = [10.0 ** (k % 23 - 12) * (1 + k * 7919 % 1000) for k in range(2000)]
    tied = [1.0] * 400 + [2.0] * 400
    for values in (wide, tied, [3.5]):
        d = spark.createDataFrame([(v,) for v in [*values, math.nan, math.inf, None]], "v double")
        probs = [0.0, 0.25, 0.5, 0.99, 1.0]
        assert np.allclose(exact_quantiles(d, "v", probs, few=7, parts=16), np.quantile(values, probs), rtol=1e-12, atol=0)
    assert exact_quantiles(d.limit(0), "v", [0.5]) == [None]


def test_pair_places_and_back(spark):
    from pyspark.sql import functions as F

    from gridweave.operators import units

    for n in (2, 5, 722):
        pairs = [(i, j, n) for j in range(n) for i in range(j + 1, n)]
        d = spark.createDataFrame(pairs[:: max(1, len(pairs) // 5000)] + pairs[-1:], "i long, j long, n long").withColumn("k", units.pair_index("i", "j", "n"))
        i, j = units.pair_of("k", "n")
        assert d.where((i != F.col("i")) | (j != F.col("j"))).isEmpty()
        assert d.agg(F.max("k")).first()[0] == n * (n - 1) // 2 - 1


def test_run_names_by_hand(spark):
    import hashlib

    from pyspark.sql import functions as F

    from gridweave.operators import runs

    d = spark.createDataFrame([(1, ["/x/HVN_15000_NR_plain.parquet", "b.parquet"]), (2, []), (3, ["a_b.parquet"])], "id int, p array<string>")
    got = {r.id: r.t for r in d.select("id", runs.dataset_tag(F.col("p")).alias("t")).collect()}
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:6]
    assert got == {1: "hvn_nr_n2_" + sha("HVN_15000_NR_plain|b"), 2: "ds_n0", 3: "ds_n1_" + sha("a_b")}
    model = spark.range(1).select(runs.model_tag(F.lit("GNSMsg_SelfAttention-armijo__")).alias("m")).first().m
    assert model == "attn_armijo"
    logs = spark.createDataFrame([("MODEL:A_b, d: 8\nd: 9 d_hi: 32",), ("",), (None,)], "value string")
    first, *rest = [tuple(r)[1:] for r in runs.parse_run_logs(logs).collect()]
    assert first == ("A_b", 8, 32, 1, 10, 0.3, 0.1) and rest == [("GNSMsg_EdgeSelfAttn_VnFeat", 4, 16, 1, 10, 0.3, 0.1)] * 2
