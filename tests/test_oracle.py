"""Every registered query with a SQL twin equals DuckDB on sf0.001, and a
few are partition-count invariant."""

import pytest

import __spark_entry__ as se
from tools.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(se.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    got = se.queries()[name](spark, SF).toPandas()
    want = con.sql(se.oracle_sql()[name]).df()
    assert compare(got, want) is None


@pytest.mark.parametrize("name", ["profile_numeric_stats", "kpi_summary", "anomaly_zscore", "segments",
                                  "forecast_fit", "feature_drift", "last_n_per_key"])
def test_partition_invariance(spark, name):
    sf = "/root/testdata/sf0.01"
    results = []
    old = (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        for parts, split in ((1, "128MB"), (4, "256KB"), (16, "64KB")):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            results.append(se.queries()[name](spark, sf).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[1])
    assert compare(results[0], results[1]) is None
    assert compare(results[0], results[2]) is None


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() >= 0 and "total_revenue" in df.columns


@pytest.mark.parametrize("name", ["kpi_summary_7d", "anomaly_detect", "audit_filter", "feature_drift",
                                  "metrics_hourly", "stream_anomalies", "segments"])
def test_session_time_zone_invariance(spark, con, name):
    """Timestamps are zone-less: results must not depend on the session zone."""
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = se.queries()[name](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert compare(got, con.sql(se.oracle_sql()[name]).df()) is None
