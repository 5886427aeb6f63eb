"""Connectivity of many grids at once: whole grids in tasks, very large ones by label rounds over joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.joins import join_small


def least_labels(row: np.ndarray, bus: np.ndarray, edge_row: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bus, label) of distinct buses: the least bus that edges of the same row connect to each. Edges to no bus connect nothing."""
    names, code = np.unique(np.r_[bus, u, v], return_inverse=True)
    own, a, b = np.split(code, [len(bus), len(bus) + len(u)])
    places, first = np.unique(row * len(names) + own, return_index=True)
    # Both ends as numbers among all buses; an edge to a bus that is not there goes.
    a, b = edge_row * len(names) + a, edge_row * len(names) + b
    at_a, at_b = np.searchsorted(places, a), np.searchsorted(places, b)
    ok = (at_a < len(places)) & (at_b < len(places))
    ok[ok] = (places[at_a[ok]] == a[ok]) & (places[at_b[ok]] == b[ok])
    a, b = at_a[ok], at_b[ok]
    root = np.arange(len(places))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return row[first], bus[first], bus[first][root]


def component_labels(bus: DataFrame, edges: DataFrame, local: int = 100_000) -> DataFrame:
    """(scenario_id, bus, label): the least bus number connected to each bus within its scenario.

    ``edges``: scenario_id, u, v. Grids of up to ``local`` buses and edges are gathered and
    labelled in tasks, many at a time; larger ones by rounds of joins.
    """
    key = "scenario_id"
    rows = bus.select(key).unionByName(edges.select(key)).groupBy(key).agg(F.count("*").alias("n"))
    large = rows.where(F.col("n") > local).select(key)
    if large.isEmpty():
        return _in_tasks(bus, edges)
    large = large.checkpoint()
    is_large = lambda d: join_small(d, large.withColumn("__large", F.lit(True)), [key], "left")
    b, e = is_large(bus.select(key, "bus")), is_large(edges.select(key, "u", "v"))
    part = lambda d, yes: d.where(F.col("__large").isNotNull() if yes else F.col("__large").isNull()).drop("__large")
    return _in_tasks(part(b, False), part(e, False)).unionByName(_in_rounds(part(b, True), part(e, True)))


def _in_tasks(bus: DataFrame, edges: DataFrame) -> DataFrame:
    key = "scenario_id"
    b = bus.groupBy(key).agg(F.collect_list(F.col("bus").cast("long")).alias("buses"))
    e = edges.where("u <> v").groupBy(key).agg(F.collect_list(F.col("u").cast("long")).alias("u"), F.collect_list(F.col("v").cast("long")).alias("v"))

    def run(it):
        for batch in it:
            lists = [batch.column(c) for c in ("buses", "u", "v")]
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            rows = [np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for x in lists]
            row, number, label = least_labels(rows[0], flat[0], rows[1], flat[1], flat[2])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(number), pa.array(label)], names=[key, "bus", "label"])

    kind = bus.schema["bus"].dataType
    out = b.join(e, key, "left").mapInArrow(run, f"{key} {bus.schema[key].dataType.simpleString()}, bus long, label long")
    return out.select(key, F.col("bus").cast(kind).alias("bus"), F.col("label").cast(kind).alias("label"))


def _in_rounds(bus: DataFrame, edges: DataFrame) -> DataFrame:
    """Every round takes the least label among neighbours, then the label of that label, so that rounds grow with the logarithm of a grid's diameter.

    All grids share the rounds; those that a round leaves as they are take no part in the next.
    """
    key = "scenario_id"
    both = edges.select(key, "u", "v").unionByName(edges.select(key, F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct().checkpoint()
    labels = bus.select(key, "bus").distinct().withColumn("label", F.col("bus")).checkpoint()
    done = None
    while True:
        near = both.join(labels.select(key, F.col("bus").alias("v"), F.col("label").alias("l")), [key, "v"]).groupBy(key, F.col("u").alias("bus")).agg(F.min("l").alias("l"))
        step = labels.join(near, [key, "bus"], "left").select(key, "bus", F.least("label", F.coalesce("l", "label")).alias("new"), F.col("label").alias("old"))
        jump = step.select(key, F.col("bus").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, [key, "new"], "left").select(key, "bus", F.least("new", F.coalesce("far", "new")).alias("label"), "old").checkpoint()
        moved = step.where("label <> old").select(key).distinct().checkpoint()
        settled = step.join(moved, key, "left_anti").select(key, "bus", "label")
        done = settled if done is None else done.unionByName(settled)
        if moved.isEmpty():
            return done
        labels = step.join(moved, key, "left_semi").select(key, "bus", "label")


def edges_of(branch: DataFrame, switch: DataFrame | None = None) -> DataFrame:
    out = branch.where("status = 1").select("scenario_id", F.col("f_bus").alias("u"), F.col("t_bus").alias("v"))
    if switch is not None:
        out = out.unionByName(switch.where("closed = 1 and et = 'b'").select("scenario_id", F.col("bus").alias("u"), F.col("element").alias("v")))
    return out


def relabel(labels: DataFrame, lost: DataFrame, kept: DataFrame) -> DataFrame:
    """(scenario_id, bus, label) after edges are gone, of the components that lost one; all others keep their labels.

    ``labels`` were found with all edges; ``lost`` and ``kept``: scenario_id, u, v.
    """
    key = "scenario_id"
    broken = lost.join(labels.select(key, F.col("bus").alias("u"), "label"), [key, "u"]).select(key, "label").distinct()
    again = labels.join(broken, [key, "label"], "left_semi").select(key, "bus").checkpoint()
    return component_labels(again, kept.join(again.select(key, F.col("bus").alias("u")), [key, "u"], "left_semi"))


def drop_disconnected(bus: DataFrame, branch: DataFrame) -> DataFrame:
    """Buses of the grids that branches in service hold together; grids in several parts go."""
    labels = component_labels(bus, edges_of(branch))
    # The least bus of a grid is every bus's label if the grid is one part.
    whole = labels.groupBy("scenario_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a = b").select("scenario_id")
    return bus.join(whole, "scenario_id", "left_semi")


def reachable_from_slack(bus: DataFrame, branch: DataFrame, root: int = 0) -> DataFrame:
    """Per scenario: buses, those reachable from bus ``root`` over branches in service, and whether all are.

    They are those of the root's component, so that rounds grow with the logarithm of a grid's diameter.
    """
    key = "scenario_id"
    labels = component_labels(bus, edges_of(branch))
    own = labels.where(F.col("bus") == root).select(key, "label")
    got = labels.groupBy(key, "label").agg(F.count("*").alias("reached")).join(own, [key, "label"], "left_semi").drop("label")
    n = bus.groupBy(key).agg(F.count("*").alias("n"))
    out = n.join(got, key, "left").fillna(0, ["reached"])
    return out.withColumn("connected", (F.col("n") == F.col("reached")).cast("long"))


def unsupplied_buses(bus: DataFrame, branch: DataFrame, switch: DataFrame | None = None) -> DataFrame:
    """Buses whose component holds no slack bus in service."""
    labels = component_labels(bus, edges_of(branch, switch))
    fed = labels.join(bus.where("bus_type = 1").select("scenario_id", "bus"), ["scenario_id", "bus"], "left_semi").select("scenario_id", "label").distinct()
    return labels.join(fed, ["scenario_id", "label"], "left_anti").select("scenario_id", "bus")


def fuse_switched_buses(bus: DataFrame, switch: DataFrame) -> DataFrame:
    """(scenario_id, bus, node): buses that closed switches join get one node; nodes are numbered densely from 0."""
    closed = switch.where("closed = 1 and et = 'b'").select("scenario_id", F.col("bus").alias("u"), F.col("element").alias("v"))
    dense = F.dense_rank().over(Window.partitionBy("scenario_id").orderBy("label")) - 1
    return component_labels(bus, closed).withColumn("node", dense.cast("long")).select("scenario_id", "bus", "node")
