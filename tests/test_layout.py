"""Bucketed star layout: the lineitem-orders join needs no shuffle and the
analytics give the same answers."""

from tessera.operators import analytics as A
from tessera.plans import fixtures as fx
from tessera.sources.layout import resolver, star_layout
from tests.helpers import rows

SF = "/root/testdata/sf0.01"


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    names = star_layout(spark, SF, str(tmp_path / "star"), buckets=8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = fx.sales(spark, SF, source=resolver(spark, SF, names))
        plan = s._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        got = A.segments(fx.sales(spark, SF, customer=True, source=resolver(spark, SF, names)), 365)
        want = A.segments(fx.sales(spark, SF, customer=True), 365)
        assert rows(got) == rows(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
