"""Small numeric expressions: stable orders, draws, signed logs, run names."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key, seed: int) -> Column:
    """A seeded integer that orders rows; the same in SQL: (key * 2654435761 + seed) mod 2^32."""
    k = F.pmod((F.col(key) if isinstance(key, str) else key).cast("long"), F.lit(2147483648))
    return (k * 2654435761 + F.lit(seed)) % 4294967296


# Draws are chains of powers modulo this prime. Fifth powers permute the numbers below it (5 does not
# divide PRIME - 1), products of two of them fit 63 bits, so every engine draws the same.
PRIME = 2147483647


def _link(h: Column, k: Column) -> Column:
    square = (h * h) % PRIME
    return ((square * square) % PRIME * h % PRIME + k) % PRIME


def text_key(c) -> Column:
    """A text as a whole number below ``PRIME``, for use as a key of draws."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda h, x: (h * 257 + F.ascii(x)) % PRIME)


def draw(seed: int, *keys) -> Column:
    """A whole number from 0 to ``PRIME`` - 1 that depends on seed and whole-numbered keys only: h -> h^5 + key, from the seed on, two more steps at the end."""
    keys = [F.pmod((F.col(k) if isinstance(k, str) else k).cast("long"), F.lit(PRIME)) for k in keys]
    last = F.lit(0).cast("long")
    return F.aggregate(F.array(*keys, last, last), F.lit(seed % PRIME).cast("long"), _link)


def uniform(seed: int, *keys) -> Column:
    """A draw in (0, 1) that depends on seed and keys only, not on partitioning."""
    return (draw(seed, *keys).cast("double") + 0.5) / float(PRIME)


def uniform_in_batches(seed, *keys) -> Column:
    """``uniform`` of a seed (a number or a column) and keys without nulls, whole batches of rows at a time: the array functions of ``draw`` take rows one by one."""

    def run(h: pd.Series, *rest: pd.Series) -> pd.Series:
        h = h.to_numpy(np.int64) % PRIME
        for k in (*(r.to_numpy(np.int64) % PRIME for r in rest), 0, 0):
            square = h * h % PRIME
            h = (square * square % PRIME * h % PRIME + k) % PRIME
        return pd.Series((h + 0.5) / float(PRIME))

    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    first = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pandas_udf(run, "double")(*[c.cast("long") for c in (first, *columns)])


def normal(seed: int, *keys) -> Column:
    """A standard normal draw (Box-Muller) of seed and keys."""
    u, v = uniform(seed, *keys), uniform(seed + 1_000_003, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def text_key_sql(text: str) -> str:
    """``text_key`` in SQL."""
    return f"list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))), lambda h, x: (h * 257 + x) % {PRIME})"


def uniform_sql(seed: int, *keys: str) -> str:
    """``uniform`` in SQL."""
    links = ", ".join([f"cast({seed % PRIME} as bigint)", *[f"(cast({k} as bigint) % {PRIME} + {PRIME}) % {PRIME}" for k in keys], "0", "0"])
    square = f"((h * h) % {PRIME})"
    return f"((cast(list_reduce([{links}], lambda h, k: (({square} * {square}) % {PRIME} * h % {PRIME} + k) % {PRIME}) as double) + 5e-1) / {PRIME}e0)"


def normal_sql(seed: int, *keys: str) -> str:
    """``normal`` in SQL."""
    return f"(sqrt(-2e0 * ln({uniform_sql(seed, *keys)})) * cos(2e0 * pi() * {uniform_sql(seed + 1_000_003, *keys)}))"


def signed_log1p(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.signum(c) * F.log1p(F.abs(c))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def global_rank(df: DataFrame, order: Column, ties: str, into: str = "rank", buckets: int = 4096, top: int = 1 << 32) -> DataFrame:
    """Adds the place (from 1) of each row in the order of an integer below ``top``, ties by ``ties``.

    Rows are ranked within ranges of the integer and the ranges' counts are summed
    up, so that no task sorts the whole table.
    """
    d = df.withColumns({"__o": order, "__b": F.floor(order / (top // buckets)).cast("int")})
    counts = d.groupBy("__b").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    counts = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__o", ties))
    return d.join(F.broadcast(counts), "__b").withColumn(into, F.col("__before") + within).drop("__o", "__b", "__before")


def exact_quantiles(df: DataFrame, column: str, probs: list[float], few: int = 1_000_000, parts: int = 4096) -> list[float | None]:
    """Exact interpolated quantiles of the finite values of ``column``, as ``percentile`` gives them; nulls if there are none.

    Runs jobs, so ``df`` should be stored. Up to ``few`` values are ranked at once. Of more, each rank is
    looked for in ``parts`` equal parts of the range, then of the part that holds it, until ``few`` or
    one value are left: no task gathers more, and ties are counted before they meet.
    """
    d = df.select(F.col(column).cast("double").alias("x")).where("x > double('-infinity') and x < double('infinity')")
    n, least, most = d.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if n == 0:
        return [None] * len(probs)
    if n <= few:
        return list(d.agg(F.percentile("x", F.array(*map(F.lit, probs)))).first()[0])

    def ranked(k: int) -> float:
        lo, hi, below, inside = least, most, 0, n
        while lo < hi and inside > few:
            # Halves, as the whole range may exceed the largest double.
            part = F.least(F.floor((F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) * parts), F.lit(parts - 1)).alias("part")
            found = d.where(F.col("x").between(lo, hi)).groupBy(part).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            for r in sorted(found.collect()):  # ``parts`` rows at most
                if k < below + r.n:
                    lo, hi, inside = r.lo, r.hi, r.n
                    break
                below += r.n
        if lo == hi:
            return lo
        values = d.where(F.col("x").between(lo, hi)).groupBy("x").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        return values.withColumn("upto", upto).where(F.col("upto") > k - below).agg(F.min("x")).first()[0]

    out = []
    for p in probs:
        at = p * (n - 1)
        k = math.floor(at)
        low = ranked(k)
        out.append(low if at == k else low + (at - k) * (ranked(k + 1) - low))
    return out


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero: scaled, taken to the nearest whole number (halves away from zero) and scaled back, in doubles as in SQL."""
    by = float(10**digits)
    x = F.abs(c) * by
    whole = F.floor(x)
    near = F.signum(c) * (whole + F.when(x - whole >= 0.5, 1).otherwise(0)) / by
    # From 2^52 on doubles are whole.
    return F.when(x < 2.0**52, near).when(x < float("inf"), c * by / by).otherwise(c) + F.lit(0.0)
