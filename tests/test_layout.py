"""Grids laid out in one row each: against the matrix path, and their plans."""

import re

import pytest
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx
from gridweave.operators import layout, residual, units, ybus
from gridweave.plans import catalog

SF = "/root/testdata/sf0.001"


def tables(spark):
    bus = [(s, b, 1 if b == 0 else 2 + (b + s) % 2, 0.1 * b - s, 0.3 - 0.1 * b, 0.05 * (b % 2), 0.02 * (b % 3), 1 + 0.01 * b, 0.1 * b * s, f"bus{b}") for s in (1, 2, 3) for b in range(6)]
    branch = [(s, f, t, int((f + t + s) % 7 != 0), 0.01 * (1 + f), 0.1 + 0.01 * t, 0.02, 0.95 if f % 2 else 1.0, 30.0 if t == 3 else 0.0) for s in (1, 2) for f, t in ((0, 1), (1, 2), (2, 1), (1, 2), (2, 3), (3, 4), (4, 4), (5, 0))]
    # An end without a bus, a branch of no impedance, a grid of one bus numbered from 4.
    branch += [(2, 3, 9, 1, 0.01, 0.1, 0.0, 1.0, 0.0), (2, 0, 2, 1, 0.0, 0.0, 0.0, 1.0, 0.0)]
    bus += [(4, 4, 3, 0.5, 0.25, 0.0, 0.0, 1.0, 0.0, "x")]
    return (
        spark.createDataFrame(bus, "scenario_id long, bus long, bus_type long, p_set double, q_set double, gs double, bs double, vm double, va double, name string"),
        spark.createDataFrame(branch, "scenario_id long, f_bus long, t_bus long, status long, r double, x double, b double, tau double, shift_deg double"),
    )


def test_residual_without_a_matrix(spark):
    bus, branch = tables(spark)
    own = branch.where("t_bus < 9")
    y = ybus.build_ybus(units.branch_admittance(own), bus.select("scenario_id", "bus", "gs", "bs"), symmetric=True)
    want = residual.power_residual(bus.withColumns(Cx.polar("vm", "va").columns("u")), y)
    for given in (branch, units.branch_admittance(branch)):
        got = {(r.scenario_id, r.bus): r for r in layout.power_residual(layout.lay_out(bus, given)).collect()}
        rows = want.collect()
        assert len(got) == len(rows) == 19
        for r in rows:
            g = got[r.scenario_id, r.bus]
            assert (g.dp is None, g.dq is None) == (r.dp is None, r.dq is None)
            assert abs((g.dp or 0) - (r.dp or 0)) < 1e-9 and abs((g.dq or 0) - (r.dq or 0)) < 1e-9
            assert (g.bus_type, g.p_set, g.vm) == (r.bus_type, r.p_set, r.vm)
    assert layout.power_residual(layout.lay_out(bus.limit(0), branch)).count() == 0


def test_matrix_of_laid_out_grids(spark):
    bus, branch = tables(spark)
    entries = lambda d: {(r.scenario_id, r.i, r.j): (round(r.re, 9), round(r.im, 9)) for r in d.collect()}
    want = entries(ybus.build_ybus(units.branch_admittance(branch), bus.select("scenario_id", "bus", "gs", "bs"), symmetric=True))
    assert entries(layout.build_ybus(layout.lay_out(bus, branch))) == entries(layout.build_ybus(layout.lay_out(bus, units.branch_admittance(branch)))) == want
    assert entries(layout.build_ybus(layout.lay_out(bus.drop("gs", "bs"), branch))) == entries(ybus.build_ybus(units.branch_admittance(branch)))


def test_flows_by_hand(spark):
    """A line of known current, and losses: what enters at both ends is lost in r."""
    bus = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 0.9, -0.2)], "scenario_id long, bus long, vm double, va double")
    branch = spark.createDataFrame([(1, 0, 1, 1, 0.02, 0.1, 0.0, 1.0, 0.0, 2.0), (1, 1, 0, 0, 0.02, 0.1, 0.0, 1.0, 0.0, 2.0)], "scenario_id long, f_bus long, t_bus long, status int, r double, x double, b double, tau double, shift_deg double, rate double")
    r = layout.loading(layout.branch_flows(layout.lay_out(bus, branch))).collect()
    assert len(r) == 1
    import cmath

    i = (1 - cmath.rect(0.9, -0.2)) / complex(0.02, 0.1)
    assert abs(complex(r[0].i_f_re, r[0].i_f_im) - i) < 1e-12 and abs(r[0].i_f - r[0].i_t) < 1e-12
    assert abs(r[0].p_f + r[0].p_t - 0.02 * abs(i) ** 2) < 1e-12 and abs(r[0].loading_percent - 50 * abs(i)) < 1e-9
    none = layout.loading(layout.branch_flows(layout.lay_out(bus, branch.withColumn("rate", F.lit(0.0)))))
    assert none.first().loading_percent is None and layout.loading_summary(none).count() == 0


def test_start_modes_of_odd_grids(spark):
    bus, branch = tables(spark)
    volts = bus.select("scenario_id", "bus", "vm", "va")
    v = volts.withColumn("run_id", F.lit("label")).unionByName(volts.where("scenario_id < 3").withColumns({"run_id": F.lit("a"), "vm": F.lit(1.0), "va": F.lit(0.0)}))
    v = v.unionByName(volts.where("scenario_id = 1").withColumn("run_id", F.lit("b"))).where("not (run_id = 'label' and scenario_id = 2)")
    got = {(r.run_id, r.scenario_id): r for r in layout.start_report(layout.lay_out(bus, branch), v, "label").collect()}
    assert got.keys() == {("a", 1), ("a", 2), ("b", 1)}
    assert got["b", 1].distance == 0 and got["a", 2].distance is None and got["a", 1].distance > 0.1
    inf = {r.scenario_id: r for r in residual.residual_inf(layout.power_residual(layout.lay_out(bus, branch))).collect()}
    assert abs(got["b", 1].dp_inf - inf[1].dp_inf) < 1e-12 and abs(got["b", 1].dq_inf - inf[1].dq_inf) < 1e-12


@pytest.mark.parametrize("name", ["residual_inf", "power_residual", "convergence_rate", "combined_loss", "physics_loss_huber_setpoint", "branch_flows", "loading_summary", "ybus_build"])
def test_one_shuffle_by_scenario(spark, name):
    """One scan, one exchange by scenario; a total over all scenarios may take one more, of one row a task."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    exchanges = re.findall(r"Exchange (\w+)", plan)
    assert exchanges.count("hashpartitioning") == 1 and exchanges.count("SinglePartition") <= 1
    assert len(re.findall(r"FileScan", plan)) == 1
