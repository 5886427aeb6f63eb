import re

import pytest

from gridweave.operators import clean
from gridweave.plans import catalog
from gridweave.plans.tables import load

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_branches_without_a_self_join(spark):
    p = plan(load(spark, SF, "branch"))
    assert len(re.findall("FileScan", p)) == 1 and "Join" not in p and len(re.findall(r"Exchange hashpartitioning", p)) == 1


@pytest.mark.parametrize("name", ["ybus_compare", "dc_vs_nb_consistency", "largest_diff_entries", "transition_weights_abs_sym"])
def test_matrix_queries_take_one_scan_and_shuffle(spark, name):
    p = plan(catalog.QUERIES[name](spark, SF))
    assert len(re.findall("FileScan", p)) == 1 and "Join" not in p and len(re.findall(r"Exchange hashpartitioning", p)) == 1 and "percentile" not in p


def test_residual_by_matrix_has_no_join(spark):
    p = plan(catalog.QUERIES["power_residual_by_matrix"](spark, SF))
    assert "Join" not in p and len(re.findall("FileScan", p)) == 2 and len(re.findall(r"Exchange hashpartitioning", p)) <= 4


def test_elements_and_conflicts_from_one_scan(spark):
    p = plan(load(spark, SF, "element"))
    assert len(re.findall("FileScan", p)) == 1 and "Join" not in p and "Union" not in p


def test_expanded_rows_are_not_shuffled(spark):
    """All rows met the grids with conflicts in a shuffle."""
    p = plan(catalog.QUERIES["expand_scenarios"](spark, SF))
    assert len(re.findall("FileScan", p)) == 1 and "SortMergeJoin" not in p and len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_conflicts_as_a_column(spark):
    rows = [(1, 0, "gen", 1), (1, 0, "ext_grid", 1), (1, 1, "load", 1), (2, 0, "gen", 1), (2, 0, "gen", 0), (2, 1, "gen", 1), (None, 0, "gen", 1), (None, 0, "gen", 1)]
    e = spark.createDataFrame(rows, "scenario_id long, bus long, kind string, in_service long")
    assert {(r.scenario_id, r.c) for r in clean.in_conflict(e, "c").collect()} == {(1, True), (2, False), (None, False)}


def test_shared_grids_are_not_derived_again(spark):
    """Grids are stored once, in columns; buses and branches of classes come from there."""
    p = plan(catalog.QUERIES["share_grid"](spark, SF))
    assert "lineitem" not in p and "SortMergeJoin" not in p and "ExistingRDD" not in p
