"""Joins with a table that is usually small, whatever its size turns out to be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = 100_000, salts: int = 32) -> DataFrame:
    """``df`` joined with ``small``: broadcast after a count of at most ``most`` rows, else by a shuffle in which a common key is dealt to ``salts`` tasks.

    ``how``: inner, left or left_semi.
    """
    if small.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), on, how)
    spread = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and t != "variant"]), F.lit(salts)).cast("int")
    dealt = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", spread).join(dealt, [*on, "__salt"], how).drop("__salt")


def rank_within(df: DataFrame, by: list[str], value: str, into: str = "rank", parts: int = 64) -> DataFrame:
    """Adds the rank (from 1, equal values alike) of ``value`` within ``by``, without one task for a large group.

    A group's values are cut at ``parts`` approximate quantiles; rows are ranked within a cut, and the counts of the cuts before are added.
    """
    from pyspark.sql import Window

    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = df.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(1000)).alias("__cuts"))
    d = join_small(df, cuts, by)
    d = d.withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(value).cast("double")))).drop("__cuts")
    counts = d.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.rank().over(Window.partitionBy(*by, "__part").orderBy(value))
    ranked = d.withColumn("__in", within).join(counts, [*by, "__part"])
    return ranked.withColumn(into, (F.col("__before") + F.col("__in")).cast("long")).drop("__part", "__in", "__before")
