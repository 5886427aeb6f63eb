"""Size-homogeneous batches, block offsets, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.numbers import global_rank, hash_order
from gridweave.operators.clean import bottom_k


def size_bucket_batches(df: DataFrame, sig: list[str], batch: int | str, key: str = "scenario_id", seed: int = 42, drop_last: bool = False) -> DataFrame:
    """Adds batch_no within each signature (say N, or N and nl) and pos in the batch; incomplete batches go if ``drop_last``.

    ``batch``: a width, or a column that holds one. Rows are ordered within salts
    of the signature and the salts' counts summed up, so that a common size is not
    one task's work.
    """
    width = F.lit(batch) if isinstance(batch, int) else F.col(batch)
    d = df.withColumns({"__o": hash_order(key, seed), "__s": F.floor(hash_order(key, seed) / (1 << 26)).cast("int")})
    within = F.row_number().over(Window.partitionBy(*sig, "__s").orderBy("__o", key))
    counts = d.groupBy(*sig, "__s").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*sig)
    before = F.sum("__n").over(w.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*sig, "__s", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(w).alias("__total"))
    d = d.withColumn("__w", within).join(counts, [*sig, "__s"])
    at = F.col("__before") + F.col("__w") - 1
    d = d.withColumns({"batch_no": F.floor(at / width).cast("long"), "pos": F.pmod(at, width).cast("long")})
    if drop_last:
        d = d.where((F.col("batch_no") + 1) * width <= F.col("__total"))
    return d.drop("__o", "__s", "__w", "__before", "__total")


def node_budget_batches(df: DataFrame, max_nodes: int, cap: int, size: str = "n", **options) -> DataFrame:
    """Batches of one size of at most ``max_nodes`` nodes and ``cap`` rows, one row at least."""
    width = F.greatest(F.lit(1), F.least(F.lit(cap), F.floor(F.lit(max_nodes) / F.col(size)))).cast("long")
    return size_bucket_batches(df.withColumn("width", width), [size], "width", **options)


def block_offsets(df: DataFrame, batch: list[str], order: str, nodes: str = "n", branches: str = "nl") -> DataFrame:
    """Adds node_offset and branch_offset of every row inside its batch."""
    w = Window.partitionBy(*batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({"node_offset": F.coalesce(F.sum(nodes).over(w), F.lit(0)), "branch_offset": F.coalesce(F.sum(branches).over(w), F.lit(0))})


def block_diagonal(offsets: DataFrame, batch: list[str], bus: DataFrame, branch: DataFrame, ybus: DataFrame | None = None) -> dict[str, DataFrame]:
    """One sparse grid for each batch: the grids of a batch side by side, with shifted bus numbers.

    ``offsets``: scenario_id, the ``batch`` columns, n, nl, node_offset and branch_offset
    (``block_offsets``). Gives ``nodes`` (node in place of bus), ``edges`` (src and dst
    shifted, edge numbered in the batch by ends and columns), ``pointers`` (graph in the batch, its first
    node and edge and the ends behind its last) and, of ``ybus``, ``matrix`` (i and j shifted).
    """
    key, at = "scenario_id", ["scenario_id", *batch, "node_offset", "branch_offset"]
    place, off = offsets.select(*at), F.col("node_offset")
    own = lambda d, taken: [c for c in d.columns if c not in (key, *taken)]
    nodes = bus.join(place, key).select(*batch, (F.col("bus") + off).alias("node"), key, *own(bus, ["bus"]))
    values = own(branch, ["f_bus", "t_bus"])
    number = F.row_number().over(Window.partitionBy(key).orderBy("f_bus", "t_bus", *values)) - 1
    edges = branch.withColumn("__k", number).join(place, key)
    edges = edges.select(*batch, (F.col("branch_offset") + F.col("__k")).cast("long").alias("edge"), (F.col("f_bus") + off).alias("src"), (F.col("t_bus") + off).alias("dst"), key, *values)
    graph = F.row_number().over(Window.partitionBy(*batch).orderBy("node_offset", key)) - 1
    ends = [(F.col("node_offset") + F.col("n")).alias("node_end"), (F.col("branch_offset") + F.col("nl")).alias("branch_end")]
    out = {"nodes": nodes, "edges": edges, "pointers": offsets.select(*batch, graph.cast("long").alias("graph"), key, "node_offset", ends[0], "branch_offset", ends[1])}
    if ybus is not None:
        out["matrix"] = ybus.join(place, key).select(*batch, (F.col("i") + off).alias("i"), (F.col("j") + off).alias("j"), "re", "im")
    return out


def one_per_size(df: DataFrame, size: str = "n", key: str = "scenario_id") -> DataFrame:
    """The first scenario of each size."""
    return df.groupBy(size).agg(F.min(key).alias(key))


def fill_to_k(df: DataFrame, k: int, strategy: str = "cycle", size: str = "n", key: str = "scenario_id", seed: int = 42) -> DataFrame:
    """Exactly k rows of each size: around its rows in turn (cycle), its first again and again (first), or by draw (random)."""
    if k < 1:
        return df.select(size, F.lit(0).cast("long").alias("slot"), key).limit(0)
    order = hash_order(key, seed) if strategy == "random" else F.col(key)
    need = 1 if strategy == "first" else k
    rows = df.select(size, key).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(256)))
    # The first rows of a size are among the first of its salts, so a common size is not one task's work.
    for by in ([size, "__s"], [size]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, key))
        rows = rows.withColumn("__r", rank).where(F.col("__r") <= need)
    rows = rows.drop("__s")
    sizes = df.groupBy(size).agg(F.count("*").alias("__n"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    if strategy == "first":
        pick = F.lit(1)
    elif strategy == "cycle":
        pick = F.pmod(F.col("slot"), F.col("__n")) + 1
    else:
        pick = F.pmod(hash_order(F.col("slot") + F.col(size) * 7919, seed), F.least(F.col("__n"), F.lit(k))) + 1
    slots = slots.withColumn("__r", pick.cast("int"))
    return slots.join(rows, [size, "__r"]).select(size, F.col("slot").cast("long").alias("slot"), key)


def split(df: DataFrame, ratios: tuple[float, float], key: str = "scenario_id", seed: int = 42) -> DataFrame:
    """Adds split: the first int(ratio * n) rows in hash order train, the next valid, the rest test."""
    n = df.agg(F.count("*").alias("__n"))
    ranked = global_rank(df, hash_order(key, seed), key, "__r").crossJoin(F.broadcast(n))
    a, b = (F.floor(F.lit(r) * F.col("__n")) for r in ratios)
    name = F.when(F.col("__r") <= a, "train").when(F.col("__r") <= a + b, "valid").otherwise("test")
    return ranked.withColumn("split", name).drop("__r", "__n")


def split_equal3(df: DataFrame, key: str = "scenario_id", seed: int = 42) -> DataFrame:
    """Thirds; what division by three leaves goes to train, then valid."""
    n = df.agg(F.count("*").alias("__n"))
    ranked = global_rank(df, hash_order(key, seed), key, "__r").crossJoin(F.broadcast(n))
    third, left = F.floor(F.col("__n") / 3), F.col("__n") % 3
    a = third + (left > 0).cast("int")
    b = a + third + (left > 1).cast("int")
    name = F.when(F.col("__r") <= a, "train").when(F.col("__r") <= b, "valid").otherwise("test")
    return ranked.withColumn("split", name).drop("__r", "__n")


def cap_split(df: DataFrame, caps: dict[str, int], key: str = "scenario_id", seed: int = 42) -> DataFrame:
    """At most caps[split] rows of each split, the first in hash order; splits without a cap stay whole."""
    parts = []
    for name, cap in caps.items():
        parts.append(bottom_k(df.where(F.col("split") == name), cap, key, seed))
    out = df.where(~F.col("split").isin(list(caps)))
    for p in parts:
        out = out.unionByName(p)
    return out


def train_subset(df: DataFrame, fraction: float, least: int, key: str = "scenario_id", seed: int = 7) -> DataFrame:
    """A seeded part of the train split, rounded half to even, ``least`` rows or more but none for fraction 0; other splits stay whole."""
    train = df.where("split = 'train'")
    n = train.agg(F.count("*").alias("__n"))
    ranked = global_rank(train, hash_order(key, seed), key, "__r").crossJoin(F.broadcast(n))
    kept = ranked.where(F.col("__r") <= (F.greatest(F.bround(F.lit(float(fraction)) * F.col("__n"), 0), F.lit(float(least))) if fraction > 0 else F.lit(0.0))).drop("__r", "__n")
    return kept.unionByName(df.where("split <> 'train'"))
