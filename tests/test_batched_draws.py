from pyspark.sql import functions as F

from gridweave.functions.numbers import uniform, uniform_in_batches
from gridweave.plans import catalog

SF = "/root/testdata/sf0.001"


def test_draws_in_batches_are_the_same(spark):
    d = spark.range(-200, 5000).withColumn("k", F.col("id") * 7919 - 3)
    assert d.where(uniform_in_batches(7, "id", "k", F.lit(5)) != uniform(7, "id", "k", F.lit(5))).isEmpty()
    by_row = F.when(F.col("id") % 2 == 0, 3).otherwise(4)
    assert d.where(uniform_in_batches(by_row, "k") != F.when(F.col("id") % 2 == 0, uniform(3, "k")).otherwise(uniform(4, "k"))).isEmpty()


def test_expansion_draws_in_batches(spark):
    """Row by row array functions took most of the time."""
    plan = catalog.QUERIES["expand_scenarios"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(array(" not in plan
