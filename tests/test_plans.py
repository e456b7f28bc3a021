"""Physical-plan properties of the registered queries."""

import pytest

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"
SQL_NAMES = sorted(se.oracle_sql())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def static_plans(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield lambda name: plan_of(se.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


@pytest.mark.parametrize("name", SQL_NAMES)
def test_no_pairwise_joins(static_plans, name):
    p = static_plans(name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_period_filter_reaches_scan(static_plans):
    p = static_plans("nl_sql_top_products")
    assert "GreaterThanOrEqual(o_orderdate" in p
    p = static_plans("segments")
    assert "GreaterThan(o_orderdate" in p


def test_column_pruning(static_plans):
    p = static_plans("kpi_summary")
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in p


def test_top_k_per_key_is_prelimited(static_plans):
    for name in ("last_n_per_key", "semantic_search"):
        p = static_plans(name)
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_latest_state_is_partial_aggregate(static_plans):
    assert "partial_max_by" in static_plans("alert_state")


def test_unique_counts_without_expand(static_plans):
    assert "Expand" not in static_plans("profile_unique")
