"""Scenario tables by expansion: every draw depends on (seed, scenario, element) alone, so results do not depend on partitioning."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.joins import join_small
from gridweave.functions.numbers import normal, text_key, uniform, uniform_in_batches
from gridweave.operators.topology import component_labels, edges_of, least_labels, relabel

PRESET_SCHEMA = "level string, scale_lo double, scale_hi double, sigma_p double, sigma_q double, sigma_gen double, vm_lo double, vm_hi double, random_start boolean, angle_jitter_deg double, mag_jitter double, outage double"
# The published scenario presets, in the order of the schema; no range means no scaling.
PRESETS = [
    ("easy", 0.90, 1.10, 0.02, 0.03, 0.01, 0.998, 1.002, False, 0.5, 0.002, 0.0),
    ("no_change", None, None, 0.0, 0.0, 0.0, 1.0, 1.0, False, 0.0, 0.0, 0.0),
    ("A", 0.70, 1.30, 0.05, 0.08, 0.03, 0.97, 1.03, True, 3.0, 0.01, 0.0),
    ("B", 0.60, 1.40, 0.10, 0.15, 0.05, 0.95, 1.05, True, 5.0, 0.02, 0.01),
    ("C", 0.50, 1.50, 0.15, 0.15, 0.08, 0.93, 1.07, True, 7.0, 0.03, 0.02),
]


def presets(spark) -> DataFrame:
    """The five presets (small; broadcast)."""
    return spark.createDataFrame(PRESETS, PRESET_SCHEMA)


def expand_scenarios(element: DataFrame, n: int, preset: DataFrame, seed: int = 42) -> DataFrame:
    """n operating points of every base grid: one global scale (0.05 or more; 1 without a range) per draw on loads and generators.

    Static generators keep their values.
    ``element`` has grid scenario_id; adds draw (from 0) and the preset's columns.
    """
    draws = element.sparkSession.range(n).withColumnRenamed("id", "draw")
    out = element.crossJoin(F.broadcast(draws)).crossJoin(F.broadcast(preset.withColumn("__level", text_key("level"))))
    out = out.withColumn("__u", uniform_in_batches(seed, "scenario_id", "draw", "__level"))
    u = F.col("__u")
    drawn = F.greatest(F.lit(0.05), F.col("scale_lo") + (F.col("scale_hi") - F.col("scale_lo")) * u)
    scale = F.when(F.col("scale_lo").isNull(), 1.0).otherwise(drawn)
    scaled = F.col("p_mw") * scale
    p = F.when(F.col("kind") == "load", scaled).when(F.col("kind") == "gen", F.greatest(scaled, F.lit(0.0))).otherwise(F.col("p_mw"))
    q = F.when(F.col("kind") == "load", F.col("q_mvar") * scale).otherwise(F.col("q_mvar"))
    return out.withColumns({"p_mw": p, "q_mvar": q, "scale": scale}).drop("__u", "__level")


# Published cases whose voltage controllers conflict, so that their set-points stay.
SET_POINT_CASES = ("GBnetwork", "GBreducednetwork")


def jitter_elements(expanded: DataFrame, conflicts: DataFrame | str | None = None, case: str | None = None, seed: int = 43) -> DataFrame:
    """Independent normal factors on load P and Q and generator P; new generator set-points but in grids where controllers conflict.

    Those are the grids in ``conflicts``, or where the column of that name holds (``clean.in_conflict`` adds one before
    rows are expanded, which spares a join of all of them), and those whose name in column ``case`` is among ``SET_POINT_CASES``.
    """
    # Loads draw for P and Q, generators for P and the set-point: two draws a row, seeded by kind.
    gen, levels = F.col("kind") == "gen", {"load": text_key(F.lit("load")), "gen": text_key(F.lit("gen"))}
    first, second = F.when(gen, seed + 2).otherwise(seed), F.when(gen, seed + 3).otherwise(seed + 1)
    chains = {"__u1": first, "__v1": first + 1_000_003, "__u2": second, "__v2": second + 1_000_003}
    kind = F.when(gen, levels["gen"]).when(F.col("kind") == "load", levels["load"]).otherwise(0)
    level = F.coalesce(*[F.when(F.col("level") == p[0], text_key(F.lit(p[0]))) for p in PRESETS], text_key("level"))
    columns, key = expanded.columns, ["scenario_id", "draw", "__level", "__kind", "bus"]
    out = expanded.withColumns({"__kind": kind, "__level": level})
    out = out.withColumns({n: uniform_in_batches(c, *key) for n, c in chains.items()})
    normal = lambda k: F.sqrt(-2 * F.log(F.col(f"__u{k}"))) * F.cos(2 * math.pi * F.col(f"__v{k}"))
    load = F.col("kind") == "load"
    p = F.col("p_mw") * F.when(load, 1 + F.col("sigma_p") * normal(1)).when(gen, 1 + F.col("sigma_gen") * normal(1)).otherwise(1.0)
    out = out.withColumns({"p_mw": p, "q_mvar": F.col("q_mvar") * F.when(load, 1 + F.col("sigma_q") * normal(2)).otherwise(1.0)})
    drawn = F.col("vm_lo") + (F.col("vm_hi") - F.col("vm_lo")) * F.col("__u2")
    free = F.col("kind") == "gen"
    if case is not None:
        free = free & ~F.coalesce(F.col(case).isin(*SET_POINT_CASES), F.lit(False))
    if isinstance(conflicts, str):
        free = free & ~F.col(conflicts)
    elif conflicts is not None:
        out = out.join(conflicts.select("scenario_id", F.lit(True).alias("__c")).distinct(), "scenario_id", "left")
        free = free & F.col("__c").isNull()
    return out.withColumn("vm_pu", F.when(free, drawn).otherwise(F.col("vm_pu"))).select(*columns)


def sample_outages(bus: DataFrame, branch: DataFrame, p: float, seed: int = 44, local: int = 100_000) -> DataFrame:
    """Active branches fail with probability ``p``; a scenario in which a bus would lose its supply keeps all of them.

    Parallel circuits are told apart by their place among the branches of the same ends.
    Grids of up to ``local`` buses and branches are gathered and looked at in tasks, many at a
    time; of larger ones only the components that lost a branch are labelled again, by rounds of joins.
    """
    key = "scenario_id"
    same_ends = Window.partitionBy(key, "f_bus", "t_bus").orderBy(*[c for c in branch.columns if c not in (key, "f_bus", "t_bus")])
    hit = (F.col("status") == 1) & (uniform(seed, key, "f_bus", "t_bus", "__k") < p)
    drawn = branch.withColumn("__k", F.row_number().over(same_ends)).withColumn("__hit", hit).drop("__k")
    rows = bus.select(key).unionByName(branch.select(key)).groupBy(key).agg(F.count("*").alias("n"))
    large = rows.where(F.col("n") > local).select(key)
    if large.isEmpty():
        return _outages_in_tasks(bus, drawn)
    large = large.checkpoint()
    is_large = lambda d: join_small(d, large.withColumn("__large", F.lit(True)), [key], "left")
    b, d = is_large(bus), is_large(drawn)
    part = lambda d, yes: d.where(F.col("__large").isNotNull() if yes else F.col("__large").isNull()).drop("__large")
    return _outages_in_tasks(part(b, False), part(d, False)).unionByName(_outages_in_rounds(part(b, True), part(d, True)))


def _undone(row: np.ndarray, bus: np.ndarray, slack: np.ndarray, edge_row: np.ndarray, u: np.ndarray, v: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Rows (grids) in which a bus has supply over all edges and none over those that are not hit."""
    names = np.unique(bus)
    place = lambda row, bus: row * len(names) + np.searchsorted(names, bus)
    supplied = []
    for on in (np.ones(len(u), bool), ~hit):
        of, at, label = least_labels(row, bus, edge_row[on], u[on], v[on])
        label = place(of, label)
        supplied.append(np.isin(label, label[np.searchsorted(place(of, at), place(row[slack], bus[slack]))]))
    return np.unique(of[supplied[0] & ~supplied[1]])


def _outages_in_tasks(bus: DataFrame, drawn: DataFrame) -> DataFrame:
    key, columns = "scenario_id", [c for c in drawn.columns if c != "__hit"]

    @F.arrow_udf("boolean")
    def undone(buses: pa.Array, slacks: pa.Array, us: pa.Array, vs: pa.Array, hits: pa.Array) -> pa.Array:
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in (buses, slacks, us, vs, hits)]
        of = lambda x: np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        out = np.zeros(len(buses), bool)
        if len(flat[0]):
            out[_undone(of(buses), flat[0], flat[1].astype(bool), of(us), flat[2], flat[3], flat[4].astype(bool))] = True
        return pa.array(out)

    lines = F.struct(*[c for c in drawn.columns if c != key])
    edge = F.when((F.col("status") == 1) & F.col("f_bus").isNotNull() & F.col("t_bus").isNotNull(), F.struct(F.col("f_bus").cast("long").alias("u"), F.col("t_bus").cast("long").alias("v"), F.coalesce("__hit", F.lit(False)).alias("hit")))
    l = drawn.groupBy(key).agg(F.collect_list(lines).alias("__l"), F.collect_list(edge).alias("__e"))
    own = F.struct(F.col("bus").cast("long").alias("bus"), F.coalesce(F.col("bus_type") == 1, F.lit(False)).alias("slack"))
    b = bus.where("bus is not null").groupBy(key).agg(F.collect_list(own).alias("__b"))
    undo = undone("__b.bus", "__b.slack", "__e.u", "__e.v", "__e.hit")
    out = l.join(b, key, "left").withColumn("__undo", undo).select(key, F.explode("__l").alias("__l"), "__undo").select(key, "__l.*", "__undo")
    return out.withColumn("status", F.when(F.col("__hit") & ~F.col("__undo"), 0).otherwise(F.col("status"))).select(*columns)


def _outages_in_rounds(bus: DataFrame, drawn: DataFrame) -> DataFrame:
    key = "scenario_id"
    drawn = drawn.checkpoint()
    lost = drawn.where("__hit").select(key, F.col("f_bus").alias("u"), F.col("t_bus").alias("v"))
    touched = lost.select(key).distinct()
    seen = bus.select(key, "bus", "bus_type").join(touched, key, "left_semi")
    before = component_labels(seen, edges_of(drawn.join(touched, key, "left_semi")))
    after = relabel(before, lost, edges_of(drawn.where("not __hit")))
    fed = lambda labels: labels.join(seen.where("bus_type = 1").select(key, "bus"), [key, "bus"], "left_semi").select(key, "label").distinct()
    # A bus loses its supply if its component had a slack bus and its part of it has none.
    was = before.join(fed(before), [key, "label"], "left_semi").select(key, "bus")
    undone = after.join(fed(after), [key, "label"], "left_anti").join(was, [key, "bus"], "left_semi")
    undone = undone.select(key).distinct().withColumn("__undo", F.lit(True))
    out = drawn.join(undone, key, "left")
    return out.withColumn("status", F.when(F.col("__hit") & F.col("__undo").isNull(), 0).otherwise(F.col("status"))).drop("__hit", "__undo")


def flat_start(bus: DataFrame, gens: DataFrame, vm_noise: float = 0.0, va_noise: float = 0.0, seed: int = 45) -> DataFrame:
    """Start voltages: set-points on generator buses, else 1; optional noise on PQ magnitudes and non-slack angles."""
    g = gens.where("kind = 'gen' and in_service = 1").groupBy("scenario_id", "bus").agg(F.max("vm_pu").alias("__g"))
    j = bus.join(g, ["scenario_id", "bus"], "left")
    key = ["scenario_id", "bus"]
    vm = F.coalesce("__g", F.lit(1.0)) + F.when(F.col("bus_type") == 3, vm_noise * normal(seed, *key)).otherwise(0.0)
    va = F.when(F.col("bus_type") != 1, va_noise * normal(seed + 1, *key)).otherwise(0.0)
    return j.withColumns({"vm_start": vm, "va_start": va}).drop("__g")


def random_grids(spark, gridtypes: dict[str, tuple[int, int, float]], n: int, seed: int = 46, connect: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(buses, pairs) of n random grids per type; gridtypes: name -> (least N, most N, kV).

    Bus k > 0 is connected to a random lower bus, so that grids hold together,
    and other pairs with probability ``connect``. Line values are drawn per pair.
    """
    types = spark.createDataFrame([(k, *v) for k, v in gridtypes.items()], "gridtype string, lo int, hi int, vn_kv double")
    grids = spark.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(types))
    grids = grids.withColumn("scenario_id", F.xxhash64("gridtype", "draw"))
    grids = grids.withColumn("n", (F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * uniform(seed, "scenario_id"))).cast("long"))
    bus = grids.select("scenario_id", "gridtype", "vn_kv", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bus"))
    u = lambda k, *c: uniform(seed + k, "scenario_id", *c)
    kind = F.when(F.col("bus") == 0, 1).when(u(1, "bus") < 0.2, 2).otherwise(3)
    bus = bus.withColumns({"bus_type": kind, "p_set": 2 * u(2, "bus") - 1, "q_set": u(3, "bus") - 0.5})
    pair = bus.where("bus > 0").select("scenario_id", "vn_kv", F.col("bus").alias("j"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("bus") - 1)).alias("i"))
    linked = (F.col("i") == F.floor(F.col("j") * u(4, "j"))) | (u(5, "i", "j") < connect)
    km = 1 + 9 * u(6, "i", "j")
    pair = pair.withColumns({"connected": linked.cast("long"), "r": km * (0.05 + 0.25 * u(7, "i", "j")), "x": km * (0.2 + 0.2 * u(8, "i", "j")), "b": km * 3e-6 * (1 + u(9, "i", "j"))})
    return bus, pair


def load_bounds(snapshots: DataFrame) -> DataFrame:
    """Range of P and Q of every load over all snapshots."""
    return snapshots.groupBy("load_id").agg(F.min("p").alias("p_min"), F.max("p").alias("p_max"), F.min("q").alias("q_min"), F.max("q").alias("q_max"))


def widest_loads(bounds: DataFrame, k: int) -> DataFrame:
    return bounds.withColumn("width", F.col("p_max") - F.col("p_min")).orderBy(F.desc("width"), "load_id").limit(k)


def sample_envelope(bounds: DataFrame, n: int, mode: str = "coupled", seed: int = 47) -> DataFrame:
    """n draws of every load inside its bounds; P and Q share one draw (``coupled``) or have their own (``independent``)."""
    out = bounds.crossJoin(F.broadcast(bounds.sparkSession.range(n).withColumnRenamed("id", "draw")))
    u = uniform(seed, "load_id", "draw")
    v = u if mode == "coupled" else uniform(seed + 1, "load_id", "draw")
    return out.select("draw", "load_id", (F.col("p_min") + u * (F.col("p_max") - F.col("p_min"))).alias("p"), (F.col("q_min") + v * (F.col("q_max") - F.col("q_min"))).alias("q"))


def with_variants(scenarios: DataFrame, variants: DataFrame, most: int = 10_000) -> DataFrame:
    """Every scenario with every variant (a few rows: start modes, presets; at most ``most``, which is checked)."""
    if variants.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} variants")
    return scenarios.crossJoin(F.broadcast(variants))
