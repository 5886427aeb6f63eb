"""Selecting, repairing and checking grid element tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.joins import join_small
from gridweave.functions.numbers import global_rank, hash_order
from gridweave.llm.common import maybe_among, stored


def bottom_k(df: DataFrame, k: int, key: str, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """The ``k`` first rows in hash order: the smallest of every partition, then of those; no row of the others is moved.

    Of more than ``most`` rows, ranks decide, as that many would meet in one task.
    """
    if k <= most:
        return df.orderBy(hash_order(key, seed), key).limit(max(k, 0))
    return global_rank(df, hash_order(key, seed), key, "__rank").where(F.col("__rank") <= k).drop("__rank")


def reservoir_sample(df: DataFrame, cap: int, key: str, seed: int = 42) -> DataFrame:
    """A seeded uniform sample of exactly min(cap, rows) rows: the first ``cap`` in hash order."""
    return bottom_k(df, cap, key, seed)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a seeded order that does not depend on partitioning; adds ``position`` (from 1)."""
    return global_rank(df, hash_order(key, seed), key, "position")


def drop_nonconverged(df: DataFrame) -> DataFrame:
    return df.where("converged = 1")


def filter_cases(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    return df.where(F.col(column).isin(names))


def filter_sizes(df: DataFrame, start: int, end: int, step: int, column: str = "n") -> DataFrame:
    """Sizes from start to end by step."""
    return df.where(F.col(column).between(start, end) & ((F.col(column) - start) % step == 0))


def missing_sizes(df: DataFrame, start: int, end: int, step: int, column: str = "n") -> DataFrame:
    """Requested sizes without a row."""
    want = df.sparkSession.sql(f"select explode(sequence({start}L, {end}L, {step}L)) as {column}")
    return want.join(df.select(column).distinct(), column, "left_anti")


def limit_violations(bus: DataFrame, vm: str = "vm", low: float = 0.95, high: float = 1.05) -> DataFrame:
    """Counts of buses below and above the voltage band per scenario."""
    return bus.groupBy("scenario_id").agg(F.count_if(F.col(vm) < low).alias("under"), F.count_if(F.col(vm) > high).alias("over"))


def odd_elements(element: DataFrame) -> DataFrame:
    """Generators with set-points outside 0.8 to 1.2, and loads of negative power."""
    return element.where("(kind = 'gen' and (vm_pu < 8e-1 or vm_pu > 12e-1)) or (kind = 'load' and p_mw < 0)")


def clean_grid(bus: DataFrame, branch: DataFrame, element: DataFrame, unsupplied: DataFrame) -> dict[str, DataFrame]:
    """Unsupplied buses and zero-impedance branches go out of service, odd set-points become 1; with counts of each."""
    off = unsupplied.select("scenario_id", "bus", F.lit(1).alias("__off"))
    b = bus.join(off, ["scenario_id", "bus"], "left").withColumn("in_service", F.when(F.col("__off").isNull(), 1).otherwise(0)).drop("__off")
    zero = (F.col("r") == 0) & (F.col("x") == 0)
    l = branch.withColumn("fixed", zero & (F.col("status") == 1)).withColumn("status", F.when(zero, 0).otherwise(F.col("status")))
    bad = (F.col("kind") == "gen") & ~F.col("vm_pu").between(0.8, 1.2)
    e = element.withColumn("fixed", bad).withColumn("vm_pu", F.when(bad, 1.0).otherwise(F.col("vm_pu")))
    counts = (
        b.agg(F.lit("unsupplied_buses").alias("what"), F.count_if(F.col("in_service") == 0).alias("n"))
        .unionByName(l.agg(F.lit("zero_impedance").alias("what"), F.count_if(F.col("fixed")).alias("n")))
        .unionByName(e.agg(F.lit("set_points").alias("what"), F.count_if(F.col("fixed")).alias("n")))
    )
    return {"bus": b, "branch": l.drop("fixed"), "element": e.drop("fixed"), "counts": counts}


def force_branch_shunt(branch: DataFrame, cases: DataFrame, transformer: Column) -> DataFrame:
    """Adds the listed cases' g, b, g_asym, b_asym (case_name, add_g, add_b, ...) to their transformer-like branches."""
    out = join_small(branch, cases, ["case_name"], "left")
    for c in ("g", "b", "g_asym", "b_asym"):
        have = F.coalesce(F.col(c), F.lit(0.0)) if c in branch.columns else F.lit(0.0)
        out = out.withColumn(c, have + F.when(transformer, F.coalesce(F.col(f"add_{c}"), F.lit(0.0))).otherwise(0.0))
    return out.drop(*[f"add_{c}" for c in ("g", "b", "g_asym", "b_asym")])


def override_trafo_params(trafo: DataFrame, pfe_kw: float | None = None, i0_percent: float | None = None) -> DataFrame:
    given = {k: F.lit(v) for k, v in (("pfe_kw", pfe_kw), ("i0_percent", i0_percent)) if v is not None}
    return trafo.withColumns(given) if given else trafo


def inject_elements(bus: DataFrame, element: DataFrame) -> DataFrame:
    """Power injected at every bus: generators and static ones less loads, in service only."""
    sign = F.when(F.col("kind") == "load", -1.0).otherwise(1.0)
    q = F.when(F.col("kind") == "gen", 0.0).otherwise(sign * F.col("q_mvar"))
    per = element.where("in_service = 1").groupBy("scenario_id", "bus").agg(F.sum(sign * F.col("p_mw")).alias("p_inj"), F.sum(q).alias("q_inj"))
    return bus.join(per, ["scenario_id", "bus"], "left").fillna(0.0, ["p_inj", "q_inj"])


def map_bus_ids(element: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds bus_idx: the looked-up index of ``bus``, or its place among the scenario's buses where there is none."""
    buses = element.select("scenario_id", "bus").distinct()
    place = buses.withColumn("__place", F.row_number().over(Window.partitionBy("scenario_id").orderBy("bus")) - 1)
    out = element.join(lookup.select("scenario_id", "bus", "idx"), ["scenario_id", "bus"], "left").join(place, ["scenario_id", "bus"])
    return out.withColumn("bus_idx", F.coalesce("idx", "__place").cast("long")).drop("idx", "__place")


def grid_classes(bus: DataFrame, branch: DataFrame, bus_cols: list[str], branch_cols: list[str]) -> DataFrame:
    """(scenario_id, grid_id, copies): scenarios of the very same grid share the least scenario_id among them.

    A grid is its buses (bus, ``bus_cols``) and branches (f_bus, t_bus, ``branch_cols``) in any
    order, repeated rows included. Classes come from whole grids, whose copies
    are counted before they meet; rows learn their class by a fingerprint
    once no two classes share one, else by the grid itself. Grids whose fingerprint no other has are classes of their own.
    """
    return _classes(_rows(bus, branch, bus_cols, branch_cols))


def grid_classes_of_items(items: DataFrame, bus_cols: list[str], branch_cols: list[str]) -> DataFrame:
    """``grid_classes`` of grids whose buses and branches are rows of one table; a row's other columns are null."""
    return _classes(_rows_of_items(items, bus_cols, branch_cols))


def _rows(bus: DataFrame, branch: DataFrame, bus_cols: list[str], branch_cols: list[str]) -> DataFrame:
    """(scenario_id, b, l): a bus or a branch in each row."""
    key, of_bus, of_branch = "scenario_id", _struct(bus, ["bus", *bus_cols]), _struct(branch, ["f_bus", "t_bus", *branch_cols])
    none = lambda d, c: F.lit(None).cast(d.select(c).schema[0].dataType)
    return bus.select(key, of_bus.alias("b"), none(branch, of_branch).alias("l")).unionByName(branch.select(key, none(bus, of_bus).alias("b"), of_branch.alias("l")))


def _rows_of_items(items: DataFrame, bus_cols: list[str], branch_cols: list[str]) -> DataFrame:
    b, l = _struct(items, ["bus", *bus_cols]), _struct(items, ["f_bus", "t_bus", *branch_cols])
    is_bus = F.col("bus").isNotNull()
    return items.select("scenario_id", F.when(is_bus, b).alias("b"), F.when(~is_bus, l).alias("l"))


def _struct(d: DataFrame, cols: list[str]) -> Column:
    """The columns together; negative zeros become zeros."""
    return F.struct(*[(F.col(c) + 0.0).cast(t).alias(c) if t in ("double", "float") else F.col(c) for c, t in d.select(*cols).dtypes])


def _whole(rows: DataFrame) -> DataFrame:
    """(scenario_id, buses, branches, fingerprint) of rows (scenario_id, b, l), a bus or a branch each; one grouping gathers both.

    Stored in columns, where the few values that grids have take a few bits each."""
    listed = lambda c: F.sort_array(F.collect_list(c))
    whole = rows.groupBy("scenario_id").agg(listed("b").alias("buses"), listed("l").alias("branches")).where(F.size("buses") > 0)
    return stored(whole.withColumn("fingerprint", F.xxhash64("buses", "branches")), "grids")


def _same(whole: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grids (as ``_whole`` has them) that surely have no copy, the others, and the classes of these: fingerprint, buses, branches, grid_id, copies.

    Fingerprints tell most grids without a copy, which are not shuffled."""
    repeated = stored(whole.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "fingerprints")
    told = whole.withColumn("__among", maybe_among(repeated, "fingerprint"))
    alone, others = told.where("not __among").drop("__among"), told.where("__among").drop("__among")
    classes = others.groupBy("fingerprint", "buses", "branches").agg(F.min("scenario_id").alias("grid_id"), F.count("*").alias("copies"))
    return alone, others, stored(classes, "classes")


def _named(alone: DataFrame, others: DataFrame, classes: DataFrame) -> DataFrame:
    """``grid_classes`` of what ``_same`` returns."""
    key, of = "scenario_id", ["grid_id", "copies"]
    if classes.groupBy("fingerprint").count().where("count > 1").isEmpty():
        named = join_small(others.select(key, "fingerprint"), classes.select("fingerprint", *of), ["fingerprint"])
    else:
        same = F.col("w.fingerprint").eqNullSafe(F.col("c.fingerprint")) & F.col("w.buses").eqNullSafe(F.col("c.buses")) & F.col("w.branches").eqNullSafe(F.col("c.branches"))
        named = others.alias("w").join(classes.alias("c"), same)
    return named.select(key, *of).unionByName(alone.select(key, F.col(key).alias("grid_id"), F.lit(1).cast("long").alias("copies")))


def _classes(rows: DataFrame) -> DataFrame:
    """``grid_classes`` of rows (scenario_id, b, l), a bus or a branch each."""
    return _named(*_same(_whole(rows)))


def share_grid(bus: DataFrame, branch: DataFrame, bus_cols: list[str], branch_cols: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(buses, branches, scenarios): every distinct grid's rows once, under grid_id, and the grid_id of every scenario (``grid_classes``)."""
    return _shared(_rows(bus, branch, bus_cols, branch_cols))


def share_grid_of_items(items: DataFrame, bus_cols: list[str], branch_cols: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``share_grid`` of grids whose buses and branches are rows of one table, as in ``grid_classes_of_items``."""
    return _shared(_rows_of_items(items, bus_cols, branch_cols))


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    alone, others, classes = _same(_whole(rows))
    grids = classes.select("grid_id", "buses", "branches").unionByName(alone.select(F.col("scenario_id").alias("grid_id"), "buses", "branches"))
    grids = grids.where("grid_id is not null")
    kept = lambda c: grids.select("grid_id", F.explode(c).alias("row")).select("grid_id", "row.*")
    return kept("buses"), kept("branches"), _named(alone, others, classes)


def controller_conflicts(element: DataFrame) -> DataFrame:
    """Buses with more than one voltage controller in service."""
    gens = element.where("kind in ('gen', 'ext_grid') and in_service = 1")
    return gens.groupBy("scenario_id", "bus").agg(F.count("*").alias("controllers")).where("controllers > 1")


def in_conflict(element: DataFrame, into: str) -> DataFrame:
    """``element`` with a boolean: whether its grid has a bus as in ``controller_conflicts``. Takes one shuffle by scenario_id at most."""
    at_bus, grid = Window.partitionBy("scenario_id", "bus"), Window.partitionBy("scenario_id")
    gens = F.count_if(F.expr("kind in ('gen', 'ext_grid') and in_service = 1")).over(at_bus)
    d = element.withColumn("__gens", gens)
    return d.withColumn(into, F.col("scenario_id").isNotNull() & (F.max("__gens").over(grid) > 1)).drop("__gens")


def gen_membership(bus: DataFrame, element: DataFrame) -> DataFrame:
    """Generators, and those in service, of every bus."""
    per = element.where("kind = 'gen'").groupBy("scenario_id", "bus").agg(F.count("*").alias("gens"), F.count_if(F.col("in_service") == 1).alias("gens_on"))
    return bus.select("scenario_id", "bus").join(per, ["scenario_id", "bus"], "left").fillna(0, ["gens", "gens_on"])


def isolated_buses(bus: DataFrame, branch: DataFrame) -> DataFrame:
    """Buses that no branch touches."""
    ends = branch.select("scenario_id", F.explode(F.array("f_bus", "t_bus")).alias("bus"))
    return bus.join(ends, ["scenario_id", "bus"], "left_anti")


def elements_on(element: DataFrame, buses: DataFrame) -> DataFrame:
    return element.join(buses.select("scenario_id", "bus"), ["scenario_id", "bus"], "left_semi")


def switch_only_buses(bus: DataFrame, branch: DataFrame, switch: DataFrame) -> DataFrame:
    """Buses off all branches that a switch touches."""
    key = ["scenario_id", "bus"]
    on_branch = branch.select("scenario_id", F.explode(F.array("f_bus", "t_bus")).alias("bus"))
    on_switch = switch.select("scenario_id", F.explode(F.array("bus", "element")).alias("bus"))
    return bus.select(*key).subtract(on_branch).intersect(on_switch)
