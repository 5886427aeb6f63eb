"""Feature tables for graph models, as projections of the long tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, cx
from gridweave.functions.numbers import signed_log1p
from gridweave.operators.units import voltage_class_feature
from gridweave.operators.ybus import active_branches


def directed_edges(branch: DataFrame) -> DataFrame:
    """Every active branch in both directions with the same series and shunt values."""
    cols = ["y_ft_re", "y_ft_im", "ysh_f_re", "ysh_f_im"]
    a = active_branches(branch)
    return a.select("scenario_id", F.col("f_bus").alias("src"), F.col("t_bus").alias("dst"), *cols).unionByName(a.select("scenario_id", F.col("t_bus").alias("src"), F.col("f_bus").alias("dst"), *cols))


def transition_weights(ybus: DataFrame, source: str = "abs", norm: str = "row", eps: float = 1e-12) -> DataFrame:
    """Off-diagonal weights |Y| (``abs``) or 1 where that is not 0 (``binary``), scaled by row or column sums, or by the roots of the row sums of both ends (``sym``)."""
    size = Cx.of("re", "im").abs()
    w = ybus.where("i <> j").select("scenario_id", "i", "j", (F.when(size > 0, 1.0).otherwise(0.0) if source == "binary" else size).alias("w"))
    least = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(eps))
    total = lambda c: F.sum("w").over(Window.partitionBy("scenario_id", c))
    if norm == "sym":
        # A weight is summed with its row, and meets the sum of its column's bus there: one window, no join.
        at = lambda bus, own: F.struct(F.col(bus).alias("bus"), F.lit(own).alias("own"))
        w = w.select("*", F.explode(F.array(at("i", True), at("j", False))).alias("__at"))
        other = F.sum(F.when(F.col("__at.own"), F.col("w"))).over(Window.partitionBy("scenario_id", F.col("__at.bus")))
        w = w.withColumn("__other", other).where("not __at.own").withColumn("__own", total("i"))
        return w.select("scenario_id", "i", "j", (F.col("w") / (F.sqrt(least(F.col("__own"))) * F.sqrt(least(F.col("__other"))))).alias("w"))
    return w.withColumn("w", F.col("w") / least(total({"row": "i", "col": "j"}[norm])))


def khop_diffuse(weights: DataFrame, x: DataFrame, hops: int, sigma: float) -> DataFrame:
    """Sum of exp(-h^2 / 2 sigma^2) T^h x over h = 1..hops, over the sum of these weights; 0 without hops or neighbours. ``x``: scenario_id, bus, x."""
    share = [math.exp(-h * h / (2 * max(sigma, 1e-12) ** 2)) for h in range(hops + 1)]
    if hops > 1:
        # Every hop reads the weights, and its own step is read twice.
        weights = weights.checkpoint()
    step = x.select("scenario_id", "bus", "x")
    total = step.select("scenario_id", "bus", F.lit(0.0).alias("y"))
    for h in range(1, hops + 1):
        from_j = step.select("scenario_id", F.col("bus").alias("j"), "x")
        step = weights.join(from_j, ["scenario_id", "j"]).groupBy("scenario_id", F.col("i").alias("bus")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        step = step.checkpoint() if h < hops else step
        total = total.unionByName(step.select("scenario_id", "bus", (F.col("x") * share[h]).alias("y")))
    return total.groupBy("scenario_id", "bus").agg((F.sum("y") / max(sum(share[1:]), 1e-12)).alias("x"))


def _logged(c, transform: str):
    c = F.col(c) if isinstance(c, str) else c
    return signed_log1p(c) if transform == "signed_log" else c


def edge_features_10(branch: DataFrame, rate: float = 0.0, transform: str = "signed_log") -> DataFrame:
    """Both directions of active branches: flows (unknown, 0), own and transfer admittance, tap, angle limits, rate."""
    a = Cx.polar("tau", F.radians("shift_deg"))
    y, own = cx("y_ft"), cx("y_from") + cx("ysh_f") * 0.5
    tau2 = F.col("tau") * F.col("tau")
    yff, ytt, yft, ytf = own * (1 / tau2), cx("y_to") + cx("ysh_t") * 0.5, -(y / a.conj()), -(y / a)

    def side(src, dst, first, second, direction):
        vals = (first.re, first.im, second.re, second.im)
        return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(direction).alias("dir"), *[_logged(v, transform).alias(f"e{k}") for k, v in enumerate(vals)])

    both = F.explode(F.array(side("f_bus", "t_bus", yff, yft, 0), side("t_bus", "f_bus", ytt, ytf, 1)))
    out = active_branches(branch).select("scenario_id", "tau", both.alias("s")).select("scenario_id", "s.*", "tau")
    return out.withColumns({"p_e": F.lit(0.0), "q_e": F.lit(0.0), "ang_min": F.lit(-math.pi), "ang_max": F.lit(math.pi), "rate": F.lit(rate)})


# The features that a model is to predict, which are masked in its input.
MASKED = {"bus": ("vm", "va"), "gen": ("pg",)}


def bus_features_15(bus: DataFrame, vn_mode: str = "log", transform: str = "signed_log", vm_limits: tuple[float, float] = (0.5, 1.5), q_limits: tuple[float, float] = (-10.0, 10.0)) -> DataFrame:
    """Demand, start voltage, one-hot type, limits, shunts and voltage class (``voltage_class_feature``) of every bus."""
    kind = lambda k: (F.col("bus_type") == k).cast("double")
    return voltage_class_feature(bus, vn_mode).select(
        "scenario_id", "bus", _logged(-F.col("p_set"), transform).alias("pd"), _logged(-F.col("q_set"), transform).alias("qd"), F.lit(0.0).alias("qg"),
        "vm", "va", (~F.col("bus_type").isin(1, 2)).cast("double").alias("is_pq"), kind(2).alias("is_pv"), kind(1).alias("is_slack"),
        *[F.lit(v).alias(n) for n, v in zip(("vm_min", "vm_max", "qg_min", "qg_max"), (*vm_limits, *q_limits))],
        _logged("gs", transform).alias("gs"), _logged("bs", transform).alias("bs"), F.col("vn_feature").alias("vn"),
    )


def _with_generator(bus: DataFrame) -> DataFrame:
    """Slack and PV buses (bus 0 where a scenario has none), numbered as ``idx`` in each scenario."""
    has = bus.where("bus_type in (1, 2)")
    lone = bus.where("bus = 0").join(has.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return _numbered(has.unionByName(lone))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy("scenario_id").orderBy("bus")) - 1).cast("long"))


def gen_features_7(bus: DataFrame, transform: str = "signed_log", p_limits: tuple[float, float] = (-10.0, 10.0)) -> DataFrame:
    """Generators (gen, with the bus that each is linked to): output of zero at least, its limits, cost terms (unknown, 0), in service."""
    pg = _logged(F.greatest("p_set", F.lit(0.0)), transform)
    costs = [F.lit(0.0).alias(f"c{k}") for k in range(3)]
    return _with_generator(bus).select("scenario_id", F.col("idx").alias("gen"), "bus", pg.alias("pg"), F.lit(p_limits[0]).alias("pg_min"), F.lit(p_limits[1]).alias("pg_max"), *costs, F.lit(1.0).alias("on"))


def hetero_tables(bus: DataFrame, branch: DataFrame, transformer=None, vm_limits: tuple[float, float] = (0.5, 1.5), rate: float = 0.0) -> dict[str, DataFrame]:
    """Tables by kind of node and edge: bus, generator (11 features), load, shunt, ac_line (9), transformer (11).

    idx and bus of generators, loads and shunts are their links, to be read either way. Features named
    z and a number are not known and 0. Branches with a tap or shift count as transformers,
    and those for which ``transformer`` (a column of ``branch``) holds. Scenarios without a kind have no such rows.
    """
    zero = lambda *names: [F.lit(0.0).alias(n) for n in names]
    limit = lambda c, s: F.col(c) + s * F.greatest(F.abs(c) * 0.5, F.lit(10.0))
    kind = F.when(F.col("bus_type").isin(1, 2), F.col("bus_type")).otherwise(3).cast("long")
    load = bus.where("p_set <> 0 or q_set <> 0")
    shunt = bus.where("gs <> 0 or bs <> 0")
    y = cx("y_ft")
    use = y.abs() > 1e-12
    y = Cx(F.when(use, y.re).otherwise(F.col("y_from_re")), F.when(use, y.im).otherwise(F.col("y_from_im")))
    tiny, z = y.abs() <= 1e-12, y.inverse()
    tap = F.when(F.abs("tau") < 1e-9, 1.0).otherwise(F.col("tau"))
    is_trafo = (F.abs(F.col("tau") - 1) > 1e-8) | (F.abs("shift_deg") > 1e-8)
    is_trafo = is_trafo if transformer is None else is_trafo | transformer
    angles = [F.lit(-math.pi).alias("ang_min"), F.lit(math.pi).alias("ang_max")]
    series = [F.when(tiny, 0.0).otherwise(v).alias(n) for n, v in (("r", z.re), ("x", z.im))]
    shunts = [(F.col("ysh_f_im") / 2).alias("b_from"), (F.col("ysh_t_im") / 2).alias("b_to")]
    on, ends = active_branches(branch), ["scenario_id", "f_bus", "t_bus"]
    return {
        "bus": bus.select("scenario_id", "bus", "vn_kv", kind.alias("bus_type"), F.lit(vm_limits[0]).alias("vm_min"), F.lit(vm_limits[1]).alias("vm_max"), F.col("vm").alias("v_setpoint")),
        "generator": _with_generator(bus).select(
            "scenario_id", "idx", "bus", F.lit(1.0).alias("on"), *zero("z1"), limit("p_set", -1).alias("p_min"), limit("p_set", 1).alias("p_max"), *zero("z4"),
            limit("q_set", -1).alias("q_min"), limit("q_set", 1).alias("q_max"), F.col("vm").alias("vg"), *zero("z8", "z9", "z10"),
        ),
        "load": _numbered(load).select("scenario_id", "idx", "bus", F.greatest(-F.col("p_set"), F.lit(0.0)).alias("pd"), F.greatest(-F.col("q_set"), F.lit(0.0)).alias("qd")),
        "shunt": _numbered(shunt).select("scenario_id", "idx", "bus", "bs", "gs"),
        "ac_line": on.where(~is_trafo).select(*ends, *angles, *shunts, *series, F.lit(rate).alias("rate"), *zero("z7", "z8")),
        "transformer": on.where(is_trafo).select(*ends, *angles, *series, F.lit(rate).alias("rate"), *zero("z5", "z6"), tap.alias("tap"), F.radians("shift_deg").alias("shift"), *shunts),
    }
