"""The nightly sales rollup kept up to date: only days that new files touch are computed again.

``refresh_sales_days`` lists the files of orders and line items, takes those that no earlier run
has seen, finds the days of their orders (also orders that only got new lines) and overwrites
these days' folders (dynamic partition overwrite) from all rows of the days. The files seen are
noted last: a run that is lost in between computes the same days again. Totals are added up
from the day rows, which hold exact decimals, so they equal those of a full rebuild.

Files are only ever added. If a file seen before is gone or has changed, everything is rebuilt;
changes of customers or parts need ``full=True``. Rows without an order date are a day of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import money
from tessera.session import complete_folders

FILE = ["table", "path", "length", "modificationTime"]


def listed_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, path, length, modificationTime) of the Parquet files of each table; contents are not read."""
    out = None
    for name, path in paths.items():
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
        one = reader.load(path).select(F.lit(name).alias("table"), "path", "length", "modificationTime")
        out = one if out is None else out.unionByName(one)
    return out


def day_rows(sales: DataFrame) -> DataFrame:
    """(day, region, brand, revenue, quantity, lines), revenue as an exact decimal."""
    return sales.groupBy(F.to_date("o_orderdate").alias("day"), F.col("r_name").alias("region"), F.col("p_brand").alias("brand")).agg(
        F.sum(money("revenue")).alias("revenue"), F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))


def changed_days(spark: SparkSession, new: DataFrame, orders: str, lines: str) -> list:
    """The days (null: no date) of orders in new files and of orders with lines in new files."""
    files: dict[str, list[str]] = {}
    for r in new.select("table", "path").collect():     # the files of one night
        files.setdefault(r["table"], []).append(r["path"])
    day = F.to_date("o_orderdate").alias("day")
    parts = []
    if "orders" in files:
        parts.append(spark.read.parquet(*files["orders"]).select(day))
    if "lineitem" in files:
        keys = spark.read.parquet(*files["lineitem"]).select(F.col("l_orderkey").alias("o_orderkey"))
        parts.append(spark.read.parquet(orders).join(keys, "o_orderkey", "left_semi").select(day))
    days = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return [r["day"] for r in days.distinct().collect()]     # bounded by the calendar


def refresh_sales_days(spark: SparkSession, orders: str, lines: str, sales_of: Callable[[DataFrame], DataFrame], out: str,
                       full: bool = False) -> list | None:
    """Bring the day rows in ``out`` up to date; returns the days written, None for all.

    ``sales_of`` joins given orders with all line items and dimensions (``fixtures.sales`` with parts and regions)."""
    state = f"{out}-files"
    runs = complete_folders(spark, state, "run")
    now = listed_files(spark, {"orders": orders, "lineitem": lines}).persist()
    try:
        if runs and not full:
            seen = spark.read.parquet(state).select(*FILE)
            full = not seen.join(now, FILE, "left_anti").isEmpty()
            new = now.join(seen, FILE, "left_anti")
        full = full or not runs
        if full:
            rows, days, new = spark.read.parquet(orders), None, now
        else:
            days = [] if new.isEmpty() else changed_days(spark, new, orders, lines)
            rows, dated = spark.read.parquet(orders), sorted(d for d in days if d is not None)
            keep = F.lit(None in days) & F.col("o_orderdate").isNull()
            if dated:    # the bounds reach the scan
                upper = F.date_add(F.lit(dated[-1]), 1).cast("timestamp_ntz")
                keep = keep | ((F.col("o_orderdate") >= F.lit(dated[0]).cast("timestamp_ntz")) & (F.col("o_orderdate") < upper)
                               & F.to_date("o_orderdate").isin(dated))
            rows = rows.filter(keep)
        if full or days:
            # a day has regions x brands rows: one file each; writing files, not rows, is the work
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            w = day_rows(sales_of(rows)).repartition(tasks if full else min(tasks, len(days)), "day").write.mode("overwrite").partitionBy("day")
            w.option("partitionOverwriteMode", "static" if full else "dynamic").parquet(out)
        if full:
            new.write.mode("overwrite").parquet(f"{state}/run=0")
            for k in runs:       # files noted before the rebuild count no more
                if k > 0:
                    now.limit(0).write.mode("overwrite").parquet(f"{state}/run={k}")
        elif days or not new.isEmpty():
            new.write.mode("overwrite").parquet(f"{state}/run={runs[-1] + 1}")
    finally:
        now.unpersist()
    return days


def sales_totals(spark: SparkSession, out: str) -> DataFrame:
    """The rollup day > region > brand (columns of ``etl_sales_aggregation``) added up from the day rows."""
    rows = spark.read.parquet(out).withColumn("day", F.col("day").cast("timestamp_ntz"))
    return rows.rollup("day", "region", "brand").agg(
        F.grouping_id().alias("level"), F.round(F.sum("revenue"), 2).cast("double").alias("revenue"),
        F.sum("quantity").alias("quantity"), F.sum("lines").alias("lines"))
