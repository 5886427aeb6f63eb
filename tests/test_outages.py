"""Outages of whole grids in tasks, and the same by rounds; classes of grids from one table."""

from pyspark.sql import functions as F

from gridweave.operators import clean, scenarios
from gridweave.plans import catalog
from gridweave.plans.scenarios import GRID_COLS
from gridweave.plans.tables import items, load

SF = "/root/testdata/sf0.001"


def rows(d):
    return sorted(map(repr, map(tuple, d.collect())))


def test_outages_are_drawn_in_one_pass(spark):
    """Labels were joined with drawn and stored branches, round after round."""
    p = catalog.QUERIES["sample_outages"](spark, SF)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Existing RDD" not in p and "ExistingRDD" not in p and p.count("FileScan") == 2 and p.count("Join") == 1


def test_outages_in_tasks_and_in_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    bus, branch = load(spark, SF, "bus"), load(spark, SF, "branch")
    # A grid of branches without buses, one of buses alone, parallel circuits, unknown ends.
    branch = branch.unionByName(branch.limit(40).withColumn("status", F.lit(1).cast("long"))).unionByName(branch.limit(9).withColumn("scenario_id", F.lit(-5).cast("long")))
    branch = branch.unionByName(branch.limit(5).withColumn("t_bus", F.lit(None).cast("long")))
    bus = bus.unionByName(bus.limit(1).withColumn("scenario_id", F.lit(-7).cast("long")))
    in_tasks, mixed, in_rounds = (rows(scenarios.sample_outages(bus, branch, 0.3, local=n)) for n in (100_000, 9, 0))
    assert in_tasks == mixed == in_rounds and len(in_tasks) == branch.count()


def test_classes_from_one_table(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    cols = (["bus_type"], ["status"])
    one = clean.grid_classes_of_items(items(spark, SF, GRID_COLS[0]), *cols)
    two = clean.grid_classes(load(spark, SF, "bus"), load(spark, SF, "branch"), *cols)
    assert rows(one) == rows(two) and one.where("copies > 1").count() > 0
