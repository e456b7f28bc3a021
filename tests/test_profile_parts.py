"""Merged part profiles against one pass over all rows, and the sketches against their bounds."""

import pyspark.sql.functions as F
import pytest

from tessera.operators import profile as P
from tessera.operators import profile_parts as PP
from tests.helpers import rows

SF = "/root/testdata/sf0.01"
EXACT = ["column_name", "count", "mean", "std", "min", "max"]


@pytest.fixture(scope="module")
def merged(spark, tmp_path_factory):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    path = str(tmp_path_factory.mktemp("parts") / "p")
    year = F.year("l_shipdate")
    for part, rows_ in (("a", year < 1994), ("b", year == 1994), ("c", year > 1994)):
        PP.refresh_profile(li.filter(rows_), path, part)
    return li, path, {r["column_name"]: r for r in PP.merged_profile(spark, path).collect()}


def test_exact_figures_equal_one_pass(spark, merged):
    li, path, _ = merged
    want = P.profile_numeric_stats(li)
    got = PP.merged_profile(spark, path).join(want.select("column_name"), "column_name", "left_semi")
    assert rows(got.select(*EXACT)) == rows(want.select(*EXACT))


def test_sketches_keep_their_bounds(merged):
    li, _, got = merged
    n = li.count()
    for c in ("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity"):
        for p in (0.25, 0.5, 0.75):
            at = got[c][f"p{int(p * 100)}"]
            r = li.agg(F.count(F.when(F.col(c) < at, 1)).alias("below"), F.count(F.when(F.col(c) <= at, 1)).alias("upto")).first()
            assert r["below"] / n - 0.02 <= p <= r["upto"] / n + 0.02, (c, p)
    for c in li.columns:
        exact = li.agg(F.count_distinct(F.col(c).cast("string"))).first()[0]
        assert abs(got[c]["distinct"] - exact) <= max(1, 0.05 * exact), c
    want = {(r["l_returnflag"], r["count"]) for r in li.groupBy("l_returnflag").count().collect()}
    assert {(t["item"], t["count"]) for t in got["l_returnflag"]["top"]} == want


def test_a_part_done_again_replaces_itself(spark, merged, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (3.0, "x")], "a double, `b c` string")
    PP.refresh_profile(df.limit(1), path, "1")
    PP.refresh_profile(df, path, "1")
    PP.refresh_profile(df.filter("a < 0"), path, "none")
    r = {x["column_name"]: x for x in PP.merged_profile(spark, path).collect()}
    assert (r["a"]["rows"], r["a"]["count"], r["a"]["missing"], r["a"]["mean"], r["a"]["std"], r["a"]["max"]) == (3, 2, 1, 2.0, 1.4142, 3.0)
    assert r["b c"]["missing"] == 1 and r["b c"]["p50"] is None and (r["b c"]["top"][0]["item"], r["b c"]["top"][0]["count"]) == ("x", 2)


def test_columns_without_values(spark, tmp_path):
    df = spark.createDataFrame([(None, None)], "a double, s string")
    PP.refresh_profile(df, str(tmp_path / "p"), "1")
    r = {x["column_name"]: x for x in PP.merged_profile(spark, str(tmp_path / "p")).collect()}
    assert r["a"]["p50"] is None and r["a"]["mean"] is None and r["a"]["distinct"] == 0 and r["s"]["count"] == 0


def test_one_scan(spark):
    plan = PP.profile_part(spark.read.parquet(f"{SF}/lineitem.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
