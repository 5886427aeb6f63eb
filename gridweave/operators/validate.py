"""Checks of scenario tables, comparisons of snapshots, and run screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.joins import join_small


def scenario_summary(bus: DataFrame, branch: DataFrame, transformer: Column) -> DataFrame:
    """Sizes, branch kinds, voltage range and power sums of every scenario."""
    b = bus.groupBy("scenario_id").agg(F.count("*").alias("n"), F.min("vm").alias("vm_min"), F.max("vm").alias("vm_max"), F.sum("p_set").alias("p_sum"), F.sum("q_set").alias("q_sum"))
    l = branch.groupBy("scenario_id").agg(F.count("*").alias("nl"), F.count_if(F.col("status") == 1).alias("active"), F.count_if(transformer).alias("trafos"), F.count_if(~transformer).alias("lines"))
    return b.join(l, "scenario_id", "left").fillna(0, ["nl", "active", "trafos", "lines"])


def validate_shapes(bus: DataFrame, branch: DataFrame, ybus: DataFrame | None = None) -> DataFrame:
    """Per scenario the list of errors: bus numbers not 0..N-1, branch ends or matrix entries out of range, no slack."""
    n = bus.groupBy("scenario_id").agg(F.count("*").alias("n"), F.min("bus").alias("lo"), F.max("bus").alias("hi"), F.count_distinct("bus").alias("d"), F.count_if(F.col("bus_type") == 1).alias("slacks"))
    sizes = n.select("scenario_id", "n")
    ends = branch.join(sizes, "scenario_id", "left").groupBy("scenario_id").agg(
        F.count_if(F.coalesce(~(F.col("f_bus").between(0, F.col("n") - 1) & F.col("t_bus").between(0, F.col("n") - 1)), F.lit(True))).alias("bad_ends")
    )
    out = n.join(ends, "scenario_id", "full_outer")
    rules = [
        (F.col("n").isNull(), "no buses"),
        ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")), "bus numbers"),
        (F.col("slacks") != 1, "slack count"),
        (F.col("bad_ends") > 0, "branch ends"),
    ]
    if ybus is not None:
        y = ybus.join(sizes, "scenario_id", "left").groupBy("scenario_id").agg(F.count_if((F.col("i") >= F.col("n")) | (F.col("j") >= F.col("n"))).alias("bad_y"))
        out, rules = out.join(y, "scenario_id", "full_outer"), [*rules, (F.col("bad_y") > 0, "matrix size")]
    return out.select("scenario_id", F.array_compact(F.array(*[F.when(c, t) for c, t in rules])).alias("errors"))


def check_same_topology(df: DataFrame, key: str | list[str], ints: list[str], floats: list[str], reference, tol: float = 1e-8) -> DataFrame:
    """Per scenario: whether it equals the ``reference`` scenario at every ``key``, and the first field that differs."""
    key = [key] if isinstance(key, str) else key
    ref = df.where(F.col("scenario_id") == reference).select(*key, *[F.col(c).alias(f"__{c}") for c in (*ints, *floats)], F.lit(1).alias("__has"))
    m = ref.count()
    j = join_small(df, ref, key, "left")
    bad = lambda c, is_int: F.col(f"__{c}").isNull() | ((F.col(c) != F.col(f"__{c}")) if is_int else (F.abs(F.col(c) - F.col(f"__{c}")) > tol))
    flags = [F.max(bad(c, c in ints).cast("int")).alias(f"bad_{c}") for c in (*ints, *floats)]
    first = F.when(F.col("m") != m, "size")
    for c in (*ints, *floats):
        first = first.when(F.col(f"bad_{c}") == 1, c)
    first = first.when(F.col("has") != m, "keys")
    out = j.groupBy("scenario_id").agg(F.count("*").alias("m"), F.count("__has").alias("has"), *flags)
    return out.select("scenario_id", first.alias("first_difference")).withColumn("same", F.col("first_difference").isNull().cast("long"))


def check_same_grid(bus: DataFrame, branch: DataFrame, reference, bus_ints: list[str], bus_floats: list[str], branch_ints: list[str], branch_floats: list[str], tol: float = 1e-8) -> DataFrame:
    """Per scenario: whether buses and branches equal those of the ``reference`` scenario, and the first field that differs (``branch.`` before those of branches).

    Branches are matched by their ends and, if parallel, by their place among those of the same ends.
    """
    b = check_same_topology(bus, "bus", bus_ints, bus_floats, reference, tol)
    values = [*branch_ints, *branch_floats]
    place = F.row_number().over(Window.partitionBy("scenario_id", "f_bus", "t_bus").orderBy(*values))
    numbered = branch.select("scenario_id", "f_bus", "t_bus", *values).withColumn("place", place)
    l = check_same_topology(numbered, ["f_bus", "t_bus", "place"], branch_ints, branch_floats, reference, tol)
    none = branch.where(F.col("scenario_id") == reference).isEmpty()
    j = b.join(l.select("scenario_id", F.col("first_difference").alias("__l"), F.lit(True).alias("__any")), "scenario_id", "left")
    of_branch = F.when(F.col("__any").isNull(), F.lit(None) if none else F.lit("branch.size")).otherwise(F.concat(F.lit("branch."), "__l"))
    first = F.coalesce("first_difference", of_branch)
    return j.select("scenario_id", first.alias("first_difference"), first.isNull().cast("long").alias("same"))


def soft_checks(bus: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Per scenario: slack without set power, PV buses without reactive power, starts at rated voltage."""
    near = lambda c: F.abs(c) < tol
    holds = lambda when, ok: F.coalesce(F.min(F.when(when, ok.cast("long"))), F.lit(1)).cast("long")
    slack, pv = F.col("bus_type") == 1, F.col("bus_type") == 2
    return bus.groupBy("scenario_id").agg(holds(slack, near(F.col("p_set")) & near(F.col("q_set"))).alias("slack_zero"), holds(pv, near(F.col("q_set"))).alias("pv_q_zero"), holds(F.lit(True), near(F.col("vm") - 1)).alias("flat_start"))


def convergence_summary(screening: DataFrame) -> DataFrame:
    """Per case: runs, converged, failed, whether any converged, and runs per reason of failure."""
    base = screening.groupBy("case_name").agg(F.count("*").alias("n"), F.sum("converged").alias("converged"), F.count_if(F.col("converged") == 0).alias("failed"), F.max("converged").alias("any_converged"))
    reasons = screening.where("converged = 0").groupBy("case_name", "reason").agg(F.count("*").alias("k"))
    maps = reasons.groupBy("case_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "k")))).alias("reasons"))
    return base.join(maps, "case_name", "left").orderBy(F.desc("any_converged"), F.asc_nulls_last("n"), "case_name")


def zero_convergence_cases(screening: DataFrame, reasons: int = 10, samples: int = 3) -> DataFrame:
    """Cases that never converged: up to ten distinct reasons, and the first three seeds."""
    never = screening.groupBy("case_name").agg(F.max("converged").alias("c"), F.count("*").alias("n")).where("c = 0").select("case_name", "n")
    s = screening.join(never, "case_name", "left_semi")
    why = s.groupBy("case_name").agg(F.slice(F.sort_array(F.collect_set("reason")), 1, reasons).alias("reasons"))
    rank = F.row_number().over(Window.partitionBy("case_name").orderBy("seed"))
    few = s.withColumn("__r", rank).where(F.col("__r") <= samples).groupBy("case_name").agg(F.sort_array(F.collect_list("seed")).alias("seeds"))
    return never.join(why, "case_name").join(few, "case_name")


def grid_diagnostics(element: DataFrame, switch: DataFrame, bus: DataFrame) -> DataFrame:
    """One long table: (what, item, n, p, q) of switches, elements out of service and power sums, and the kV histogram.

    Rows of all three become counts of what they tell and are added up in one grouping.
    """
    none = F.lit(None).cast("double")
    mark = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    row = lambda what, item, n, p=none, q=none: F.struct(F.lit(what).alias("what"), item.cast("string").alias("item"), n.alias("n"), p.alias("p"), q.alias("q"))
    s = F.explode(F.array(*[row(f"switch_{name}", F.col("et"), mark(F.col("closed") == k)) for name, k in (("closed", 1), ("open", 0))]))
    parts = [
        switch.select(s.alias("x")),
        element.select(row("out_of_service", F.col("kind"), mark(F.col("in_service") == 0), F.col("p_mw"), F.col("q_mvar")).alias("x")),
        bus.select(row("kv", F.col("vn_kv").cast("long"), F.lit(1).cast("long")).alias("x")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("x.*")
    return rows.groupBy("what", "item").agg(*[F.sum(c).alias(c) for c in ("n", "p", "q")])


def bus_type_counts(bus: DataFrame) -> DataFrame:
    """slack, PV and PQ buses of every scenario."""
    counts = bus.groupBy("scenario_id").pivot("bus_type", [1, 2, 3]).count().fillna(0)
    return counts.select("scenario_id", F.col("1").alias("slack"), F.col("2").alias("pv"), F.col("3").alias("pq"))


def distinct_bases(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of each column by input file."""
    by = F.input_file_name().alias("file")
    return df.select(by, *columns).groupBy("file").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in columns])


def diagnosis_verdict(df: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Adds verdict from solved (0/1) and the mismatch of the solved state."""
    v = F.when(F.col("solved") == 0, "not solved").when(F.col("solved_mismatch") < tol, "start robustness").otherwise("model mismatch")
    return df.withColumn("verdict", v)


def state_diff(a: DataFrame, b: DataFrame, tol: float = 1e-10) -> DataFrame:
    """Buses whose type, set power or presence differs between two snapshots."""
    key = ["scenario_id", "bus"]
    x = a.select(*key, F.col("bus_type").alias("type_a"), F.col("p_set").alias("p_a"), F.col("q_set").alias("q_a"))
    y = b.select(*key, F.col("bus_type").alias("type_b"), F.col("p_set").alias("p_b"), F.col("q_set").alias("q_b"))
    j = x.join(y, key, "full_outer")
    ds = F.sqrt((F.col("p_a") - F.col("p_b")) ** 2 + (F.col("q_a") - F.col("q_b")) ** 2)
    changed = ~F.col("type_a").eqNullSafe(F.col("type_b")) | F.coalesce(ds > tol, F.lit(True))
    return j.where(changed).select(*key, "type_a", "type_b", ds.alias("ds"))


def compare_vectors(df: DataFrame, ref: DataFrame, key: str, fields: list[str], tol: float = 1e-9, first: int = 5) -> DataFrame:
    """Per scenario and field: how many places differ from the reference (those that it lacks, too), and the first few of them."""
    r = ref.select(key, *[F.col(f).cast("double").alias(f"__{f}") for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x"), F.col(f"__{f}").alias("y")) for f in fields]))
    long = join_small(df, r, [key], "left").select("scenario_id", key, pairs.alias("p")).select("scenario_id", key, "p.*")
    bad = F.coalesce(F.abs(F.col("x") - F.col("y")) > tol, F.lit(True))
    return long.groupBy("scenario_id", "field").agg(F.count_if(bad).alias("differing"), F.slice(F.sort_array(F.collect_list(F.when(bad, F.col(key)))), 1, first).alias("first"))


def magnetizing_delta(before: DataFrame, after: DataFrame, key: list[str], by: str, fields: list[str]) -> DataFrame:
    """Per ``by``: largest |change| and number of changed places of each field."""
    b = after.select(*key, *[F.col(f).alias(f"__{f}") for f in fields])
    aggs = []
    for f in fields:
        d = F.abs(F.col(f"__{f}") - F.col(f))
        aggs += [F.max(d).alias(f"{f}_max"), F.count_if(d > 0).alias(f"{f}_changed")]
    return before.join(b, key).groupBy(by).agg(*aggs)


def scenario_delta(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Largest |difference| of each field between two operating points of one grid."""
    y = b.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return a.join(y, key).agg(*[F.max(F.abs(F.col(f) - F.col(f"__{f}"))).alias(f"d_{f}") for f in fields])


def scenario_deltas(a: DataFrame, reference: DataFrame, scenario: str, key: str, fields: list[str]) -> DataFrame:
    """As ``scenario_delta``, of every scenario of ``a`` from one operating point; null where they share no key."""
    y = reference.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return join_small(a, y, [key], "left").groupBy(scenario).agg(*[F.max(F.abs(F.col(f) - F.col(f"__{f}"))).alias(f"d_{f}") for f in fields])


def tables_equal_rounded(a: DataFrame, b: DataFrame, digits: int = 12) -> DataFrame:
    """Rows in one table and not in the other after rounding, with the side they are on."""
    cols = a.columns
    fix = lambda d: d.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in d.select(*cols).dtypes])
    x, y = fix(a), fix(b)
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def start_voltage_stats(bus: DataFrame) -> DataFrame:
    """Per scenario: start voltage range and mean; sum and range of P and Q."""
    out = [F.min("vm").alias("vm_min"), F.max("vm").alias("vm_max"), F.avg("vm").alias("vm_mean")]
    for c in ("p_set", "q_set"):
        out += [F.sum(c).alias(f"{c}_sum"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return bus.groupBy("scenario_id").agg(*out)


def top_mismatch_buses(residual: DataFrame, k: int = 5, by: str = "scenario_id") -> DataFrame:
    """The k buses of largest max(|dp|, |dq|) of each scenario, ties to the lower number."""
    zero = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    m = residual.withColumn("mismatch", F.greatest(zero("dp"), zero("dq")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mismatch"), "bus"))
    return m.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select(by, "rank", "bus", "mismatch")


def zero_shunts(bus: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Per scenario: whether all bus shunts are (close to) zero."""
    return bus.groupBy("scenario_id").agg(((F.max(F.abs("gs")) <= tol) & (F.max(F.abs("bs")) <= tol)).cast("long").alias("no_shunts"))
