"""Values worked out by hand from the published formulas."""

import math

from gridweave.operators import batching, features, residual, runs, scenarios, units, voltage

NAN, INF = float("nan"), float("inf")


def near(a, b):
    return abs(a - b) < 1e-9


def test_voltage_errors(spark):
    m = spark.createDataFrame([("r", 0.03, 0.1), ("r", -0.01, -0.2)], "run_id string, dvm double, dva double")
    r = voltage.voltage_rmse(m, "run_id").first()
    assert near(r.rmse, math.sqrt((0.0009 + 0.0001) / 2 + (0.01 + 0.04) / 2)) and near(r.rmse_mag, math.sqrt(0.0005)) and near(r.rmse_ang_deg, math.degrees(math.sqrt(0.025)))
    # Divided by the weights 1 and 1 / pi, magnitude plus angle, mean over buses.
    assert near(voltage.mag_ang_mse(m, "run_id").first().mse, 0.0005 + 0.025 * math.pi**2)


def test_physics_loss(spark):
    rows = [(1, 3.0, 4.0, 0.5, None), (1, 0.0, 0.0, -1.0, 2.0), (1, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "scenario_id long, p_set double, q_set double, dp double, dq double")
    loss = lambda *a, **k: residual.physics_loss(df, *a, **k).first().loss
    assert near(loss("mse", "none"), (0.25 + 1 + 4) / 3)
    assert near(loss("huber", "none"), (0.125 + 0.5 + 1.5) / 6)
    # |S| is 5 and 0; 0 is raised to eps. Three entries have a residual.
    assert near(loss("mse", "setpoint", eps=0.5), (0.1**2 + 2**2 + 4**2) / 3)
    assert near(loss("mse", "graph", eps=0.5), (0.1**2 + 0.2**2 + 0.4**2) / 3)
    assert near(loss("logcosh", "graph", eps=0.5), sum(math.log(math.cosh(x)) for x in (0.1, 0.2, 0.4)) / 3)
    none = residual.physics_loss(df.limit(0), "mse", "graph").first()
    assert none.loss == 0 and residual.residual_distribution(df.limit(0)).collect()[0].within == 0


def test_khop_counts_from_the_first_hop(spark):
    w = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 1.0)], "scenario_id long, i long, j long, w double")
    x = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (2, 0, 5.0)], "scenario_id long, bus long, x double")
    got = {(r.scenario_id, r.bus): r.x for r in features.khop_diffuse(w, x, 1, 1.0).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (2, 0): 0.0}


def test_line_view_and_ratio(spark):
    b = spark.createDataFrame([(1.0, 0.0, 10.0, 10.0, 1.0, 2.0, 3.0, 4.0, 0.6), (1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 0.6)], "tau double, shift_deg double, v_f double, v_t double, y_from_re double, y_from_im double, y_ft_re double, y_ft_im double, ysh_f_im double")
    r = units.line_view(b).first()
    assert (r.y_line_re, r.y_line_im, r.c_line) == (3.0, 4.0, 0.3)
    assert [r.n for r in units.hv_side_ratio(b).collect()] == [1.0, 1.0]


def test_train_subset_rounds_half_to_even(spark):
    df = spark.createDataFrame([(i, "train") for i in range(7)] + [(9, "test")], "scenario_id long, split string")
    size = lambda f, least: batching.train_subset(df, f, least).where("split = 'train'").count()
    assert [size(0.5, 0), size(0.0, 5), size(0.1, 5), size(0.1, 50)] == [4, 0, 5, 7]


def test_compare_to_baseline(spark):
    m = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 4.0), ("d", NAN), ("e", 1.0)], "config string, value double")
    b = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 2.0), ("d", 2.0), ("e", 0.0)], "config string, value double")
    got = {r.config: (r.pct_change, r.factor) for r in runs.compare_to_baseline_run(m, b, ["config"]).collect()}
    assert got == {"a": (-100.0, -INF), "b": (-50.0, -2.0), "c": (100.0, 2.0), "d": (None, None), "e": (None, None)}


def test_outliers_leave_values_out_that_are_not_finite(spark):
    rows = [(s, b, 1.0 + 0.01 * b, 0.0) for s in range(1, 4) for b in range(4)] + [(4, 0, NAN, 0.0), (4, 1, 1.0, 0.0), (5, 0, INF, 0.0), (6, 0, 9.0, 0.0)]
    v = spark.createDataFrame(rows, "scenario_id long, bus long, vm double, va double")
    assert {r.scenario_id for r in voltage.drop_voltage_outliers(v).collect()} == {1, 2, 3, 4, 5}


def test_parallel_circuits_fail_on_their_own(spark):
    n = 400
    bus = spark.createDataFrame([(s, b, 1 if b == 0 else 3) for s in range(n) for b in (0, 1)], "scenario_id long, bus long, bus_type long")
    branch = spark.createDataFrame([(s, 0, 1, 1, x) for s in range(n) for x in (0.1, 0.1, 0.2)], "scenario_id long, f_bus long, t_bus long, status long, x double")
    out = scenarios.sample_outages(bus, branch, 0.3).groupBy("scenario_id").sum("status").collect()
    assert {r[1] for r in out} == {1, 2, 3}


def test_deep_configurations_keep_every_value(spark):
    df = spark.createDataFrame([("a", '{"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}, "h": 2}')], "id string, conf string")
    assert {(r.path, r.value) for r in runs.flatten_config(df, "id", "conf").collect()} == {("b.c.d.e.f.g", "1"), ("h", "2")}
