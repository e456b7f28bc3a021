"""Storage layout for co-located joins.

The largest join is lineitem ⋈ orders on the order key. Writing both as
tables bucketed (and sorted) by that key into the same number of buckets lets
Spark plan the join bucket-to-bucket without shuffling either side; customer
can be bucketed by customer key for the orders ⋈ customer join. Tables are
external: their files go below a folder of the shared checkpoint location
(or any path given), their definitions into the session catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.files import table

# (table, bucket key) of the co-located star layout
STAR_BUCKETS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"}


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def star_layout(spark: SparkSession, sf_dir: str, base: str, buckets: int, prefix: str = "star_") -> dict[str, str]:
    """Write the bucketed star tables; returns {table: catalog name}."""
    names = {}
    for t, key in STAR_BUCKETS.items():
        names[t] = f"{prefix}{t}"
        write_bucketed(table(spark, sf_dir, t), names[t], key, buckets, f"{base}/{t}")
    return names


def resolver(spark: SparkSession, sf_dir: str, names: dict[str, str] | None = None) -> Callable[[str], DataFrame]:
    """name -> DataFrame: catalog tables of a layout where present, else the
    Parquet files of ``sf_dir``."""
    names = names or {}

    def get(t: str) -> DataFrame:
        return spark.table(names[t]) if t in names else table(spark, sf_dir, t)
    return get
