"""Grids laid out once: a row for each scenario with its buses and branches as arrays.

Rows are partitioned by scenario_id alone, and everything that is made of a row stays
where it is: a branch's ends are looked up by bus number in the row, flows are
exploded and added up by (scenario_id, bus) without another shuffle. A grid's arrays
are as long as the grid.

Buses are numbered 0..N-1 (``validate_shapes`` tells which grids are not); an end
whose bus is not at its number carries nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, cx
from gridweave.operators.units import branch_admittance
from gridweave.operators.ybus import sum_entries, with_stamps

KEY = "scenario_id"


def lay_out(bus: DataFrame, branch: DataFrame) -> DataFrame:
    """(scenario_id, buses, branches): all columns of both tables as arrays of structs, buses in the order of their numbers.

    Grids without branches have an empty array; branches of no bus are left out.
    """
    own = [c for c in bus.columns if c not in (KEY, "bus")]
    b = bus.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("bus", *own))).alias("buses"))
    ends = F.struct(*[c for c in branch.columns if c != KEY])
    l = branch.groupBy(KEY).agg(F.collect_list(ends).alias("branches"))
    return b.join(l, KEY, "left").withColumn("branches", F.coalesce("branches", F.array().cast(l.schema["branches"].dataType)))


def with_runs(grids: DataFrame, voltage: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds runs, an array of (``run``, volts): the voltages of ``voltage`` (run, scenario_id, bus, vm, va) by run.

    One shuffle by scenario_id brings all runs of a grid to it.
    """
    each = voltage.repartition(KEY).groupBy(KEY, run).agg(F.sort_array(F.collect_list(F.struct("bus", "vm", "va"))).alias("volts"))
    return grids.join(each.groupBy(KEY).agg(F.collect_list(F.struct(run, "volts")).alias("runs")), KEY)


def _at(array: str, bus: Column) -> Column:
    """The entry of a bus number, null where it is not at its number."""
    x = F.get(array, bus.cast("int"))
    return F.when(x["bus"] == bus, x)


def _polar(v: Column) -> Cx:
    return Cx(v["vm"] * F.cos(v["va"]), v["vm"] * F.sin(v["va"]))


def _with_flows(rows: DataFrame, branch: str, volts: str) -> DataFrame:
    """Adds the columns of struct ``branch`` and, of active branches with both ends, currents and powers taken in there."""
    own = [f.name for f in rows.schema[branch].dataType.fields]
    rows = rows.select(*[c for c in rows.columns if c not in own], f"{branch}.*")
    active = (F.col("status") == 1) & (F.col("f_bus") != F.col("t_bus"))
    rows = rows.withColumns({"__f": F.when(active, _at(volts, F.col("f_bus"))), "__t": F.when(active, _at(volts, F.col("t_bus")))})
    if "y_from_re" not in own:
        rows = branch_admittance(rows)
    # Rounded step by step as in the queries' SQL, so that branches that load alike in exact numbers get the same rank.
    turn = Cx.polar(1.0, F.col("shift_deg") * F.pi() / 180.0)
    rows = rows.withColumns(_polar(F.col("__f")).columns("__u") | _polar(F.col("__t")).columns("__w") | turn.columns("__a"))
    u, w, a, tau = cx("__u"), cx("__w"), cx("__a"), F.col("tau")
    over = lambda z, by: Cx(z.re / by, z.im / by)
    # In steps, as in ``ybus.with_stamps``: one expression of all would be code too long to be compiled.
    own_f, own_t = cx("y_from") + cx("ysh_f") * 0.5, cx("y_to") + cx("ysh_t") * 0.5
    rows = rows.withColumns(own_f.columns("__ff") | own_t.columns("__tt") | (cx("y_ft") * a).columns("__ft") | (cx("y_ft") * a.conj()).columns("__tf"))
    i_f = over(cx("__ff") * u, tau * tau) - over(cx("__ft") * w, tau)
    i_t = cx("__tt") * w - over(cx("__tf") * u, tau)
    rows = rows.withColumns(i_f.columns("i_f") | i_t.columns("i_t")).drop(*[f"__{x}_{y}" for x in ("ff", "tt", "ft", "tf", "a") for y in ("re", "im")])
    s_f, s_t = u * cx("i_f").conj(), w * cx("i_t").conj()
    made = {"p_f": s_f.re, "q_f": s_f.im, "p_t": s_t.re, "q_t": s_t.im, "i_f": cx("i_f").abs(), "i_t": cx("i_t").abs()}
    return rows.withColumns(made).drop("__f", "__t", *[f"__{x}_{y}" for x in "uw" for y in ("re", "im")])


def branch_flows(grids: DataFrame, *keep: str, volts: str = "buses") -> DataFrame:
    """Currents and powers that active branches take in at both ends, from the voltages there and each branch's 2 x 2 block.

    (scenario_id, ``keep``, the branches' columns, i_f_re, i_f_im, i_t_re, i_t_im, p_f, q_f, p_t, q_t, i_f, i_t).
    Branches have tau, shift_deg and r, x, b, or their admittances; ``volts`` names the array that holds vm and va.
    """
    rows = grids.select(KEY, *keep, volts, F.explode("branches").alias("__l"))
    return _with_flows(rows, "__l", volts).where("p_f is not null and p_t is not null").drop(volts)


def loading(flows: DataFrame, rating: str = "rate") -> DataFrame:
    """Adds loading_percent: the larger end's current as a share of ``rating``; null without a positive one."""
    return flows.withColumn("loading_percent", F.when(F.col(rating) > 0, 100 * F.greatest("i_f", "i_t") / F.col(rating)))


def loading_summary(loaded: DataFrame, limit: float = 100.0) -> DataFrame:
    """Per scenario: the highest loading, the branch that has it (the lowest ends, if several), and how many are over ``limit``."""
    top = F.max(F.struct(F.col("loading_percent").alias("x"), (-F.col("f_bus")).alias("f"), (-F.col("t_bus")).alias("t")))
    per = loaded.where("loading_percent is not null").groupBy(KEY).agg(top.alias("m"), F.count_if(F.col("loading_percent") > limit).alias("overloaded"))
    return per.select(KEY, F.col("m.x").alias("max_loading"), (-F.col("m.f")).alias("f_bus"), (-F.col("m.t")).alias("t_bus"), "overloaded")


def power_residual(grids: DataFrame, *keep: str, columns: tuple[str, ...] = ("bus_type", "p_set", "q_set", "vm", "va"), volts: str = "buses", **extra: Column) -> DataFrame:
    """(scenario_id, ``keep``, bus, ``columns``, ``extra``, dp, dq): as ``residual.power_residual`` for the matrix of the same branches and shunts.

    Buses have bus_type, p_set, q_set and, if any, shunts gs and bs. The matrix is
    never made: a bus's row and what its branches take in are added up in one
    grouping. ``extra`` are further columns of a bus, made of ``b`` (its struct) and the row's arrays.
    """
    own = [f.name for f in grids.schema["buses"].dataType.elementType.fields]
    n, k = F.size("buses"), F.col("__k")
    arrays = list(dict.fromkeys(["buses", "branches", *[c for c in grids.columns if c not in (KEY, *keep)]]))
    rows = grids.select(KEY, *keep, *arrays, F.explode(F.sequence(F.lit(0), n + F.size("branches") - 1)).alias("__k"))
    rows = rows.withColumns({"b": F.when(k < n, F.get("buses", k)), "__l": F.when(k >= n, F.get("branches", k - n))})
    vm = _at(volts, F.col("b.bus"))["vm"]
    shunt = lambda c, sign: sign * F.coalesce(F.col(f"b.{c}"), F.lit(0.0)) * vm * vm if c in own else F.lit(0.0)
    rows = rows.withColumns({f"__{c}": F.col(f"b.{c}") for c in columns} | {f"__{c}": v for c, v in extra.items()} | {"__bus": F.col("b.bus"), "__gp": shunt("gs", 1.0), "__gq": shunt("bs", -1.0)})
    held = [*columns, *extra]
    rows = _with_flows(rows.select(KEY, *keep, volts, "__l", "__bus", "__gp", "__gq", *[f"__{c}" for c in held]), "__l", volts)
    item = lambda bus, p, q, own: F.struct(F.col(bus).alias("bus"), F.col(p).alias("p"), F.col(q).alias("q"), *[(F.col(f"__{c}") if own else F.lit(None).cast(rows.schema[f"__{c}"].dataType)).alias(c) for c in held])
    of_bus, of_branch = F.array(item("__bus", "__gp", "__gq", True)), F.array(item("f_bus", "p_f", "q_f", False), item("t_bus", "p_t", "q_t", False))
    items = rows.select(KEY, *keep, F.explode(F.when(F.col("__bus").isNotNull(), of_bus).when(F.col("p_f").isNotNull() & F.col("p_t").isNotNull(), of_branch)).alias("x")).select(KEY, *keep, "x.*")
    sums = items.groupBy(KEY, *keep, "bus").agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"), *[F.max(c).alias(c) for c in held])
    dp, dq = (F.col(c) - F.coalesce(s, F.lit(0.0)) for c, s in (("p_set", "__p"), ("q_set", "__q")))
    return sums.withColumns({"dp": F.when(F.col("bus_type") != 1, dp), "dq": F.when(F.col("bus_type") == 3, dq)}).drop("__p", "__q")


def build_ybus(grids: DataFrame, symmetric: bool = True) -> DataFrame:
    """The entries that ``ybus.build_ybus`` gives for the same branches and shunts, made where the grid is."""
    n, k = F.size("buses"), F.col("__k")
    rows = grids.select(KEY, "buses", "branches", F.explode(F.sequence(F.lit(0), n + F.size("branches") - 1)).alias("__k"))
    own = [f.name for f in grids.schema["buses"].dataType.elementType.fields]
    rows = rows.select(KEY, F.when(k < n, F.get("buses", k)).alias("__b"), F.when(k >= n, F.get("branches", k - n)).alias("__l"))
    value = lambda c: F.coalesce(F.col(f"__b.{c}"), F.lit(0.0)) if c in own else F.lit(0.0)
    return build_ybus_items(rows.select(KEY, F.col("__b.bus").alias("bus"), value("gs").alias("gs"), value("bs").alias("bs"), "__l.*"), symmetric)


def build_ybus_items(items: DataFrame, symmetric: bool = True) -> DataFrame:
    """The entries of grids whose buses (bus, gs, bs) and branches are rows of one table; a row's other columns are null.

    Rows that come partitioned by scenario_id are summed where they are.
    """
    rows = items.withColumnsRenamed({"bus": "__bus", "gs": "__gs", "bs": "__bs"})
    if "y_from_re" not in rows.columns:
        rows = branch_admittance(rows)
    shunt = F.array(F.struct(F.col("__bus").alias("i"), F.col("__bus").alias("j"), F.col("__gs").alias("re"), F.col("__bs").alias("im")))
    active = (F.col("status") == 1) & (F.col("f_bus") != F.col("t_bus"))
    has_shunt = F.col("__bus").isNotNull() & ((F.col("__gs") != 0) | (F.col("__bs") != 0))
    rows = with_stamps(rows, symmetric)
    entries = rows.select(KEY, F.explode(F.when(has_shunt, shunt).when(active, F.col("__stamps"))).alias("e"))
    return sum_entries(entries.select(KEY, "e.*"))


def start_report(grids: DataFrame, voltage: DataFrame, solved: str, run: str = "run_id") -> DataFrame:
    """Per start mode (``run``) and scenario: largest distance of a start voltage from the solved one, and the start's largest mismatches.

    All modes of a grid are evaluated where the grid is: one shuffle of the voltages. Grids without a solved run have no distance.
    """
    g = with_runs(grids, voltage, run)
    found = F.get(F.filter("runs", lambda r: r[run] == solved), F.lit(0))["volts"]
    g = g.withColumn("solved", found).withColumn("__r", F.explode("runs")).where(F.col(f"__r.{run}") != solved)
    g = g.select(KEY, F.col(f"__r.{run}").alias(run), "buses", "branches", "solved", F.col("__r.volts").alias("volts"))
    gap = (_polar(_at("volts", F.col("b.bus"))) - _polar(_at("solved", F.col("b.bus")))).abs()
    res = power_residual(g, run, columns=("bus_type", "p_set", "q_set"), volts="volts", gap=gap)
    top = lambda c: F.coalesce(F.max(F.abs(c)), F.lit(0.0)).alias(f"{c}_inf")
    return res.groupBy(KEY, run).agg(F.max("gap").alias("distance"), top("dp"), top("dq"))
