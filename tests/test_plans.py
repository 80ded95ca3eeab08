"""Plans that the operators must keep."""

import re

import pytest

from armspan.plans.catalog import QUERIES

LAZY = [
    name
    for name in sorted(QUERIES)
    if not name.startswith(("scan_", "sink_", "profile_", "mlp_", "ml_", "table_io"))
]


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plans as for tables too large to broadcast; explicit hints still hold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module", autouse=True)
def full_text(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize("name", LAZY)
def test_no_python_in_the_plan(name, spark, small_dir):
    plan = _plan(QUERIES[name](spark, small_dir))
    assert not re.search(r"EvalPython|PythonUDF|InPandas|FlatMapGroups", plan)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    plan = _plan(QUERIES["filter_conjunctive"](spark, small_dir))
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan and "GreaterThan(o_totalprice,300000.0)" in plan
    plan = _plan(QUERIES["agg_by_category"](spark, small_dir))
    assert re.search(r"ReadSchema: struct<o_totalprice:double,o_orderpriority:string>", plan)


def test_aggregates_combine_before_the_shuffle(spark, small_dir):
    for name in ("agg_by_customer", "agg_by_category", "describe_by_arm", "storage_test_summary"):
        plan = _plan(QUERIES[name](spark, small_dir))
        assert plan.count("Exchange hashpartitioning") == 1
        assert "partial_sum" in plan or "partial_avg" in plan


def test_join_broadcasts_nothing_and_scans_twice(no_broadcast, small_dir):
    plan = _plan(QUERIES["join_customer_summary"](no_broadcast, small_dir))
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan
    assert plan.count("FileScan") == 2
    # The totals are exchanged after their aggregation, so that both sides of the join can be split.
    assert plan.count("Exchange hashpartitioning") == 3


def test_top_rows_need_no_full_sort(spark, small_dir):
    plan = _plan(QUERIES["preview_top_n"](spark, small_dir))
    assert "TakeOrderedAndProject(limit=5" in plan and "Exchange" not in plan


def test_one_scan_per_statistic(no_broadcast, small_dir):
    for name in ("compare_arms", "timing_key_stats", "cost_key_stats", "storage_stats_by_op", "multi_run_summary"):
        assert _plan(QUERIES[name](no_broadcast, small_dir)).count("FileScan") == 1, name


def test_costs_take_one_lookup_and_no_shuffle(no_broadcast, small_dir):
    plan = _plan(QUERIES["experiment_cost"](no_broadcast, small_dir))
    assert plan.count("BroadcastHashJoin") == 1 and "Exchange hashpartitioning" not in plan
