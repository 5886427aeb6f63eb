"""Sparse admittance matrices as long tables (scenario_id, i, j, re, im); never dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, cx

KEY = ["scenario_id", "i", "j"]


def _entry(i, j, y: Cx) -> Column:
    return F.struct(i.alias("i"), j.alias("j"), y.re.alias("re"), y.im.alias("im"))


def sum_entries(entries: DataFrame) -> DataFrame:
    return entries.groupBy(*KEY).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def active_branches(branch: DataFrame) -> DataFrame:
    """In service, and not from a bus to itself."""
    return branch.where((F.col("status") == 1) & (F.col("f_bus") != F.col("t_bus")))


def with_stamps(rows: DataFrame, symmetric: bool = False, into: str = "__stamps") -> DataFrame:
    """Adds the four entries of every branch's row (``build_ybus``) as an array.

    Values are made in steps that stay apart in the plan: written out in one
    expression they repeat each other, in code too long for the JVM to compile.
    """
    turn = Cx.polar(1.0, F.col("shift_deg") * F.pi() / 180.0)
    yft = ytf = cx("y_ft")
    if not symmetric and {"v_f", "v_t"} <= set(rows.columns):
        yft, ytf = cx("y_from") * (F.col("v_f") / F.col("v_t")), cx("y_to") * (F.col("v_t") / F.col("v_f"))
    rows = rows.withColumns(turn.columns("__a") | yft.columns("__yft") | ytf.columns("__ytf"))
    a, tau, scale = cx("__a"), F.col("tau"), F.col("tau") * F.col("tau")
    over = lambda z, by: Cx(z.re / by, z.im / by)
    own_f, own_t = over(cx("y_from") + cx("ysh_f") * 0.5, scale), cx("y_to") + cx("ysh_t") * 0.5
    made = own_f.columns("__ff") | own_t.columns("__tt") | over(-(cx("__yft") * a), tau).columns("__ft") | over(-(cx("__ytf") * a.conj()), tau).columns("__tf")
    f, t = F.col("f_bus"), F.col("t_bus")
    stamps = F.array(_entry(f, f, cx("__ff")), _entry(t, t, cx("__tt")), _entry(f, t, cx("__ft")), _entry(t, f, cx("__tf")))
    return rows.withColumns(made).withColumn(into, stamps)


def build_ybus(branch: DataFrame, shunt: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """Four stamps of every active branch and the bus shunts, summed per entry.

    ``branch`` has y_from, y_to, y_ft, ysh_f, ysh_t, tau and shift_deg. By default
    the transfer entries use each side's own series admittance scaled by the
    voltage bases in v_f, v_t where present (exact for unequal sides), else y_ft;
    ``symmetric`` uses y_ft for both. ``shunt``: (scenario_id, bus, gs, bs).
    """
    entries = with_stamps(active_branches(branch), symmetric).select("scenario_id", F.explode("__stamps").alias("e")).select("scenario_id", "e.*")
    if shunt is not None:
        own = shunt.where("gs <> 0 or bs <> 0").select("scenario_id", F.col("bus").alias("i"), F.col("bus").alias("j"), F.col("gs").alias("re"), F.col("bs").alias("im"))
        entries = entries.unionByName(own)
    return sum_entries(entries)


def build_ybus_pairs(pair: DataFrame) -> DataFrame:
    """From connected pairs (scenario_id, i, j, y_re, y_im, b): -y off the diagonal, y + jb on it."""
    y, i, j = cx("y"), F.col("i"), F.col("j")
    own = y + Cx.of(0.0, "b")
    stamps = F.array(_entry(i, j, -y), _entry(j, i, -y), _entry(i, i, own), _entry(j, j, own))
    return sum_entries(pair.select("scenario_id", F.explode(stamps).alias("e")).select("scenario_id", "e.*"))


def build_ybus_line_trafo(pair: DataFrame) -> DataFrame:
    """Pairs with is_trafo: lines with full charging b at both ends, transformers with b/2 and their tap on the lower bus."""
    y, i, j = cx("y"), F.least("i", "j"), F.greatest("i", "j")
    trafo = F.col("is_trafo")
    a = Cx.polar(F.when(trafo, F.col("tau")).otherwise(1.0), F.radians(F.when(trafo, F.col("shift_deg")).otherwise(0.0)))
    own = y + Cx.of(0.0, F.when(trafo, F.col("b") / 2).otherwise(F.col("b")))
    stamps = F.array(_entry(i, i, own * (1 / a.abs2())), _entry(j, j, own), _entry(i, j, -(y / a.conj())), _entry(j, i, -(y / a)))
    return sum_entries(pair.select("scenario_id", F.explode(stamps).alias("e")).select("scenario_id", "e.*"))


def bus_current(ybus: DataFrame, voltage: DataFrame) -> DataFrame:
    """I = Y V per bus: (scenario_id, bus, i_re, i_im); ``voltage`` has u_re, u_im."""
    v = voltage.select("scenario_id", F.col("bus").alias("j"), "u_re", "u_im")
    part = Cx.of("re", "im") * cx("u")
    joined = ybus.join(v, ["scenario_id", "j"]).select("scenario_id", F.col("i").alias("bus"), part.re.alias("i_re"), part.im.alias("i_im"))
    return joined.groupBy("scenario_id", "bus").agg(F.sum("i_re").alias("i_re"), F.sum("i_im").alias("i_im"))


def sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries of two matrices under each other: (scenario_id, i, j, re, im, of_b)."""
    one = lambda d, of_b: d.select(*KEY, "re", "im", F.lit(of_b).alias("of_b"))
    return one(a, False).unionByName(one(b, True))


def side_differences(both: DataFrame) -> DataFrame:
    """Entries of both ``sides`` next to each other (0 where absent), |difference|, and presence; one grouping, without a shuffle if they come partitioned by scenario_id."""
    of = lambda x: F.col("of_b") if x == "b" else ~F.col("of_b")
    sums = [F.sum(F.when(of(x), F.col(c)).otherwise(0.0)).alias(f"{x}_{c}") for x in "ab" for c in ("re", "im")]
    found = both.groupBy(*KEY).agg(*sums, *[F.max(of(x)).alias(f"in_{x}") for x in "ab"])
    return found.withColumns({"diff": (cx("a") - cx("b")).abs(), "abs_b": cx("b").abs(), "abs_a": cx("a").abs()})


def entry_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side_differences`` of two matrices."""
    return side_differences(sides(a, b))


def _with_median(d: DataFrame) -> tuple[DataFrame, Column]:
    """``d`` with ``rel``, the difference relative to b where b is not 0, and the aggregate that is its median by scenario: rows are ranked by sorting."""
    d = d.withColumn("rel", F.when(F.col("abs_b") > 0, F.col("diff") / F.col("abs_b")))
    own = Window.partitionBy("scenario_id")
    d = d.withColumns({"__k": F.row_number().over(own.orderBy(F.asc_nulls_last("rel"))), "__n": F.count("rel").over(own)})
    middle = F.when((F.col("__k") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__k") == F.floor((F.col("__n") + 2) / 2)), F.col("rel"))
    return d, F.min(middle) + (F.max(middle) - F.min(middle)) * 0.5


def compare_sides(both: DataFrame, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """Per scenario: entry counts, largest and Frobenius difference, closeness, and relative differences."""
    d, median = _with_median(side_differences(both))
    return d.groupBy("scenario_id").agg(
        F.count_if("in_a").alias("nnz_a"),
        F.count_if("in_b").alias("nnz_b"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("only_a"),
        F.count_if(F.col("in_b") & ~F.col("in_a")).alias("only_b"),
        F.max("diff").alias("max_diff"),
        F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("frobenius"),
        F.min((F.col("diff") <= atol + rtol * F.col("abs_b")).cast("long")).alias("close"),
        F.max("rel").alias("rel_max"),
        F.avg("rel").alias("rel_mean"),
        median.alias("rel_median"),
    )


def compare_ybus(a: DataFrame, b: DataFrame, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """``compare_sides`` of two matrices."""
    return compare_sides(sides(a, b), atol, rtol)


def consistency_of_sides(both: DataFrame, limit: float = 1e-2) -> DataFrame:
    """Relative and diagonal differences of a reduced matrix to its target, with a verdict at ``limit``."""
    d, median = _with_median(side_differences(both))
    out = d.groupBy("scenario_id").agg(F.max("rel").alias("rel_max"), F.avg("rel").alias("rel_mean"), median.alias("rel_median"), F.max(F.when(F.col("i") == F.col("j"), F.col("diff"))).alias("diag_max"))
    return out.withColumn("verdict", F.when(F.col("rel_max") <= limit, "consistent").otherwise("inconsistent"))


def dc_vs_nb_consistency(a: DataFrame, b: DataFrame, limit: float = 1e-2) -> DataFrame:
    """``consistency_of_sides`` of two matrices."""
    return consistency_of_sides(sides(a, b), limit)


def aggregate_ybus(ybus: DataFrame, node_map: DataFrame) -> DataFrame:
    """T' Y T: entries summed over the nodes that ``node_map`` (scenario_id, bus, node) puts together."""
    m = node_map.select("scenario_id", "bus", "node")
    mi = m.select("scenario_id", F.col("bus").alias("i"), F.col("node").alias("ni"))
    mj = m.select("scenario_id", F.col("bus").alias("j"), F.col("node").alias("nj"))
    mapped = ybus.join(mi, ["scenario_id", "i"]).join(mj, ["scenario_id", "j"])
    return sum_entries(mapped.select("scenario_id", F.col("ni").alias("i"), F.col("nj").alias("j"), "re", "im"))


def switch_admittance(switch: DataFrame) -> DataFrame:
    """Closed bus-bus switches as near-ideal branches of impedance 1e-9 + j1e-6."""
    y, i, j = Cx.of(1e-9, 1e-6).inverse(), F.col("bus"), F.col("element")
    stamps = F.array(_entry(i, i, y), _entry(j, j, y), _entry(i, j, -y), _entry(j, i, -y))
    closed = switch.where("et = 'b' and closed = 1 and bus <> element")
    return sum_entries(closed.select("scenario_id", F.explode(stamps).alias("e")).select("scenario_id", "e.*"))


def add_ybus(a: DataFrame, b: DataFrame) -> DataFrame:
    return sum_entries(a.select(*KEY, "re", "im").unionByName(b.select(*KEY, "re", "im")))


def merge_parallel_branches(branch: DataFrame) -> DataFrame:
    """Active branches by their bus pair (lower, higher): summed series admittance and charging."""
    y = cx("y_ft")
    pairs = active_branches(branch).select("scenario_id", F.least("f_bus", "t_bus").alias("i"), F.greatest("f_bus", "t_bus").alias("j"), y.re.alias("y_re"), y.im.alias("y_im"), F.col("ysh_f_im").alias("b"))
    return pairs.groupBy(*KEY).agg(F.sum("y_re").alias("y_re"), F.sum("y_im").alias("y_im"), F.sum("b").alias("b"), F.count("*").alias("n"))


def scatter_pairs(pair: DataFrame, sizes: DataFrame) -> DataFrame:
    """All N(N-1)/2 pairs i < j of every scenario (scenario_id, n), with zeros where ``pair`` has none."""
    i = sizes.select("scenario_id", "n", F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("n") - 2)).otherwise(F.array().cast("array<bigint>"))).alias("i"))
    every = i.select("scenario_id", "i", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j"))
    values = pair.select(*KEY, "y_re", "y_im", "b")
    return every.join(values, KEY, "left").fillna(0.0, ["y_re", "y_im", "b"])


def pair_connectivity(pair: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pair flags (scenario_id, i, j, connected) for every pair of every scenario."""
    return scatter_pairs(pair.withColumns({"y_re": F.lit(1.0), "y_im": F.lit(0.0), "b": F.lit(0.0)}), sizes).select(*KEY, (F.col("y_re") == 1).cast("long").alias("connected"))


def ybus_sanity(ybus: DataFrame, line: DataFrame) -> DataFrame:
    """Per scenario: largest |Y - Y'|, and for single plain lines (scenario_id, i, j, y_re, y_im) largest and mean |Y_ij + y|."""
    # An entry and its mirror are grouped by their pair of buses.
    side = lambda c, name, first: F.sum(F.when(F.col("i") <= F.col("j") if first else F.col("i") >= F.col("j"), F.col(c)).otherwise(0.0)).alias(f"{name}_{c}")
    pairs = ybus.groupBy("scenario_id", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(*[side(c, n, n == "u") for n in "ut" for c in ("re", "im")])
    asym = pairs.groupBy("scenario_id").agg(F.max((cx("u") - cx("t")).abs()).alias("max_asym"))
    gap = (Cx.of("re", "im") + cx("y")).abs()
    lines = line.join(ybus, KEY).groupBy("scenario_id").agg(F.max(gap).alias("line_max"), F.avg(gap).alias("line_mean"))
    return asym.join(lines, "scenario_id", "left")


def largest_of_sides(both: DataFrame, k: int = 10) -> DataFrame:
    """The k largest differing entries over all scenarios, ties by place."""
    return side_differences(both).where("diff > 0").select(*KEY, "diff").orderBy(F.desc("diff"), *KEY).limit(k)


def largest_diff_entries(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """``largest_of_sides`` of two matrices."""
    return largest_of_sides(sides(a, b), k)
