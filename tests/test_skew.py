"""Operators stay correct when one key holds a third of all rows."""

from pyspark.sql import functions as F

from tessera.operators import frame_ops as FO
from tessera.operators import monitoring as M
from tessera.operators import profile as P

N = 30000


def skewed(spark):
    # key 0 holds a third of the rows, the rest spread over 1000 keys
    return spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000 + 1).alias("k"),
        F.col("id").alias("seq"), (F.col("id") % 7).cast("double").alias("v")).repartition(16)


def test_last_n_per_key_hot_key(spark):
    df = skewed(spark)
    got = FO.last_n_per_key(df, "k", [F.desc("seq")], n=5)
    hot = sorted(r["seq"] for r in got.filter("k = 0").collect())
    assert hot == sorted(range(0, N, 3))[-5:]
    assert got.groupBy("k").count().filter("count > 5").count() == 0


def test_latest_per_key_hot_key(spark):
    df = skewed(spark).withColumn("ts", F.col("seq"))
    got = {r["k"]: r["seq"] for r in M.latest_per_key(df, "k", ["ts"]).collect()}
    assert got[0] == max(range(0, N, 3))
    assert len(got) == 1001


def test_duplicates_and_value_counts_hot_value(spark):
    df = skewed(spark).select("k")
    r = P.profile_duplicates(df).first()
    assert r["duplicates"] == N - 1001 and r["distinct_rows"] == 1001
    u = {x["column_name"]: x["unique_values"] for x in P.profile_unique(df).collect()}
    assert u["k"] == 1001
    c = {x["column_name"]: x for x in P.profile_categorical_stats(df.select(F.col("k").cast("string").alias("k"))).collect()}
    assert c["k"]["top"] == "0" and c["k"]["freq"] == N // 3


def test_column_drift_moves_no_rows_to_their_feature(spark):
    from tessera.operators import drift as D
    df = spark.range(400).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2 % 90).cast("double").alias("b"),
                                 F.when(F.col("id") < 200, "baseline").otherwise("current").alias("w"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = D.column_psi(df, ["a", "b"], F.col("w"))
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin [coalesce(feature" in plan and "SortMergeJoin [coalesce(feature" not in plan
        assert {r["feature"]: r["status"] for r in got.collect()}["a"] == "WARNING"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
