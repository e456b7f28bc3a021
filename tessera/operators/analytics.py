"""Business analytics over the sales star schema and the events table.

Conventions
* ``as_of`` is the newest date in the data (never the wall clock). It is
  fetched first as one scalar, answered from Parquet footers when aggregate
  pushdown is on, so the period predicates that follow are plain literals
  that reach the Parquet scan (row-group pruning) and the runtime bloom
  filter on the lineitem side of the join.
* Current period = (as_of - p days, as_of]; previous = the p days before.
* Money is summed as decimal(18,4) and rounded in decimal (exact, order
  independent); derived ratios are taken from the rounded doubles.
* Windows without ``partitionBy`` are only used on aggregated inputs whose
  size is bounded by a dimension (segments, regions, funnel stages, k ranks).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import day_start, money, money_sum, ntz_lit, pct_change, safe_div, spread

# The periods that the reference's pages offer.
PERIODS = (7, 30, 90, 365)


def check_period(days: int) -> int:
    """Any whole number of days from 1 on; anything else raises."""
    if int(days) != days or days < 1:
        raise ValueError(f"period must be a positive number of days, not {days}")
    return int(days)


def scalar(df: DataFrame):
    """First column of a one-row aggregate, collected (a single value)."""
    return df.first()[0]


def as_of_date(df: DataFrame, c: str):
    return scalar(df.agg(F.max(c)))


def _ts(d) -> F.Column:
    return ntz_lit(d)


def period_bounds(as_of, days: int, n: int = 2):
    """[as_of - k*days for k in 0..n] as Python datetimes."""
    return [as_of - dt.timedelta(days=k * days) for k in range(n + 1)]


def in_period(c: str, hi, lo) -> F.Column:
    """lo < c <= hi."""
    return (F.col(c) > _ts(lo)) & (F.col(c) <= _ts(hi))


# --------------------------------------------------------------------------
def revenue_by_year(sales: DataFrame) -> DataFrame:
    """(year, revenue, prev_revenue, change_pct): yearly revenue and pct_change."""
    y = sales.groupBy(F.year("o_orderdate").alias("year")).agg(money_sum("revenue").alias("revenue"))
    w = Window.orderBy("year")   # one row per year: bounded input
    return y.select("year", "revenue", F.lag("revenue").over(w).alias("prev_revenue")) \
        .withColumn("change_pct", pct_change("revenue", "prev_revenue"))


def _fold_rows(parts: list[DataFrame]) -> DataFrame:
    """Several one-row aggregates -> one row with all their columns (as double)."""
    keys, cells = [], None
    for p in parts:
        keys += p.columns
        long = p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v"))
                                           for c in p.columns])))
        cells = long if cells is None else cells.unionByName(long)
    return cells.groupBy(F.lit(1).alias("_g")).pivot("k", keys).agg(F.first("v")).drop("_g")


# --------------------------------------------------------------------------
def kpi_summary(lineitem: DataFrame, orders: DataFrame, events: DataFrame, period: int = 30) -> DataFrame:
    """(metric, value, prev, change_pct, trend, is_positive) for the period.

    Sales metrics: revenue, orders, customers (distinct buyers),
    new_customers (first order ever inside the period), avg_order_value,
    churn_rate (% of previous-period buyers with no order now). Event
    metrics: conversion_rate (% of viewing user-days that also purchase) and
    nps (% score 9-10 minus % score 0-6, score = least(10, floor(value/10))).
    """
    p = check_period(period)
    as_of = as_of_date(orders, "o_orderdate")
    b0, b1, b2, b3 = period_bounds(as_of, p, 3)
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate").filter(F.col("o_orderdate") > _ts(b3))
    cur, prev, prev2 = in_period("o_orderdate", b0, b1), in_period("o_orderdate", b1, b2), in_period("o_orderdate", b2, b3)
    o = o.withColumn("k", F.when(cur, 0).when(prev, 1).when(prev2, 2))

    li = spread(lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")),
                ["l_orderkey"])
    rev = li.join(o.filter(F.col("k") < 2), li.l_orderkey == o.o_orderkey).agg(
        money_sum(F.when(F.col("k") == 0, F.col("revenue"))).alias("revenue_0"),
        money_sum(F.when(F.col("k") == 1, F.col("revenue"))).alias("revenue_1"))
    cnt = o.agg(F.count(F.when(F.col("k") == 0, 1)).alias("orders_0"),
                F.count(F.when(F.col("k") == 1, 1)).alias("orders_1"))
    per_cust = o.groupBy("o_custkey").agg(*[F.max((F.col("k") == i).cast("int")).alias(f"in{i}") for i in range(3)])
    cust = per_cust.agg(
        F.sum("in0").alias("customers_0"), F.sum("in1").alias("customers_1"),
        F.sum(F.when((F.col("in1") == 1) & (F.col("in0") == 0), 1).otherwise(0)).alias("lost_0"),
        F.sum(F.when((F.col("in2") == 1) & (F.col("in1") == 0), 1).otherwise(0)).alias("lost_1"),
        F.sum("in2").alias("customers_2"))
    first = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_date"))
    new = first.agg(F.count(F.when(in_period("first_date", b0, b1), 1)).alias("new_0"),
                    F.count(F.when(in_period("first_date", b1, b2), 1)).alias("new_1"))

    e_as_of = as_of_date(events, "ts")
    e0, e1, e2 = period_bounds(e_as_of, p, 2)
    ev = events.select("user_id", "ts", "event_type", "value").filter(F.col("ts") > _ts(e2)) \
        .withColumn("k", F.when(in_period("ts", e0, e1), 0).when(in_period("ts", e1, e2), 1))
    days = ev.groupBy("k", "user_id", F.to_date("ts").alias("day")).agg(
        F.max((F.col("event_type") == "view").cast("int")).alias("viewed"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    conv = days.agg(*[F.round(safe_div(F.sum(F.when((F.col("k") == i) & (F.col("viewed") == 1), F.col("bought"))) * 100.0,
                                       F.sum(F.when(F.col("k") == i, F.col("viewed")))), 2).alias(f"conv_{i}")
                      for i in range(2)])
    score = F.least(F.lit(10), F.floor(F.col("value") / 10))
    nps = ev.agg(*[F.round(safe_div(
        (F.count(F.when((F.col("k") == i) & (score >= 9), 1)) - F.count(F.when((F.col("k") == i) & (score <= 6), 1))) * 100.0,
        F.count(F.when(F.col("k") == i, 1))), 2).alias(f"nps_{i}") for i in range(2)])

    # Every piece is a global aggregate (one row): fold them into one row by a
    # union of (key, value) cells and a pivot on the known keys.
    one = _fold_rows([rev, cnt, cust, new, conv, nps])

    def aov(i):
        return F.round(safe_div(F.col(f"revenue_{i}"), F.col(f"orders_{i}")), 2)

    def churn(i):
        base = F.col(f"customers_{i + 1}")
        return F.round(safe_div(F.col(f"lost_{i}") * 100.0, base), 2)

    # (metric, current, previous, higher_is_better)
    metrics = [
        ("revenue", F.col("revenue_0"), F.col("revenue_1"), True),
        ("orders", F.col("orders_0"), F.col("orders_1"), True),
        ("customers", F.col("customers_0"), F.col("customers_1"), True),
        ("new_customers", F.col("new_0"), F.col("new_1"), True),
        ("avg_order_value", aov(0), aov(1), True),
        ("churn_rate", churn(0), churn(1), False),
        ("conversion_rate", F.col("conv_0"), F.col("conv_1"), True),
        ("nps", F.col("nps_0"), F.col("nps_1"), True),
    ]
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value"), pv.cast("double").alias("prev"),
                 F.lit(good).alias("higher_is_better")) for m, c, pv, good in metrics])))
    trend = F.when(F.col("value") > F.col("prev"), "up").otherwise("down")
    return rows.select(
        "metric", F.lit(p).alias("period_days"), "value", "prev",
        pct_change("value", "prev").alias("change_pct"), trend.alias("trend"),
        F.when(F.col("higher_is_better"), trend == "up").otherwise(trend == "down").alias("is_positive"))


# --------------------------------------------------------------------------
TIMESERIES_METRICS = ("revenue", "customers", "events", "api_requests", "churn")


def metric_timeseries(lineitem: DataFrame, orders: DataFrame, events: DataFrame, metric: str = "revenue",
                      days: int = 90, max_points: int | None = None) -> DataFrame:
    """(day, value): one point per day for the last ``days`` days, zero-filled from
    a calendar. An unknown metric, days below 1 or above ``max_points`` raise."""
    if metric not in TIMESERIES_METRICS:
        raise ValueError(f"metric must be one of {TIMESERIES_METRICS}")
    days = check_period(days)
    if max_points is not None and days > max_points:
        raise ValueError(f"{days} days are more than max_points={max_points}")
    spark = orders.sparkSession
    if metric in ("revenue", "customers"):
        as_of = as_of_date(orders, "o_orderdate")
        lo = as_of - dt.timedelta(days=days)
        o = orders.select("o_orderkey", "o_custkey", "o_orderdate").filter(F.col("o_orderdate") > _ts(lo))
        if metric == "revenue":
            li = spread(lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r")),
                        ["l_orderkey"])
            daily = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.to_date("o_orderdate").alias("day")) \
                .agg(money_sum("r").alias("value"))
        else:
            daily = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(
                F.count_distinct("o_custkey").cast("double").alias("value"))
    else:
        as_of = as_of_date(events, "ts")
        lo = dt.datetime.combine(as_of.date(), dt.time()) - dt.timedelta(days=days)
        ev = events.select("user_id", "ts", "event_type").filter(F.col("ts") >= _ts(lo))
        if metric == "events":
            daily = ev.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        elif metric == "api_requests":
            daily = ev.filter(F.col("event_type").isin("click", "view")).groupBy(F.to_date("ts").alias("day")) \
                .agg(F.count(F.lit(1)).cast("double").alias("value"))
        else:
            active = ev.select("user_id", F.to_date("ts").alias("day")).distinct()
            nxt = active.select("user_id", F.date_add("day", 1).alias("day"), F.lit(1).alias("was_active"))
            j = nxt.join(active.withColumn("is_active", F.lit(1)), ["user_id", "day"], "left")
            daily = j.groupBy("day").agg(F.round(safe_div(
                F.count(F.when(F.col("is_active").isNull(), 1)) * 100.0, F.count(F.lit(1))), 2).alias("value"))
    end = as_of.date()
    cal = spark.range(1).select(F.explode(F.sequence(ntz_lit(end - dt.timedelta(days=days - 1)), ntz_lit(end))).alias("day"))
    # one calendar row per day asked for; its join is left to AQE
    return cal.join(daily, "day", "left").select(
        F.col("day").cast("timestamp_ntz").alias("day"), F.coalesce("value", F.lit(0.0)).alias("value"))


# --------------------------------------------------------------------------
def _two_periods(sales: DataFrame, date_col: str, as_of, p: int) -> DataFrame:
    b0, b1, b2 = period_bounds(as_of, p, 2)
    return sales.filter(F.col(date_col) > _ts(b2)).withColumn(
        "k", F.when(in_period(date_col, b0, b1), 0).otherwise(1))


def segments(sales_c: DataFrame, period: int = 365) -> DataFrame:
    """Per market segment: customers, revenue, revenue_share (% 1 dp), avg_ltv, growth_pct."""
    as_of = as_of_date(sales_c, "o_orderdate")
    s = _two_periods(sales_c, "o_orderdate", as_of, period)
    agg = s.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count_distinct(F.when(F.col("k") == 0, F.col("o_custkey"))).alias("customers"),
        money_sum(F.when(F.col("k") == 0, F.col("revenue"))).alias("revenue"),
        money_sum(F.when(F.col("k") == 1, F.col("revenue"))).alias("prev_revenue"))
    w = Window.partitionBy()   # one row per segment: bounded
    return agg.select(
        "segment", "customers", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.round(safe_div(F.col("revenue") * 100.0, F.sum("revenue").over(w)), 1).alias("revenue_share"),
        F.round(safe_div("revenue", "customers"), 2).alias("avg_ltv"),
        pct_change("revenue", "prev_revenue").alias("growth_pct")).orderBy(F.desc("revenue_share"), "segment")


def top_products(sales_p: DataFrame, period: int = 365, k: int = 10, cost_factor: float = 0.5) -> DataFrame:
    """Rank 1..k products by revenue: revenue, units, margin_pct, growth_pct.

    cost = cost_factor * quantity * retail price (chosen). The top-k is a
    distributed TakeOrderedAndProject; the rank is numbered on the k rows."""
    as_of = as_of_date(sales_p, "o_orderdate")
    s = _two_periods(sales_p, "o_orderdate", as_of, period)
    cur = F.col("k") == 0
    agg = s.groupBy(F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product")).agg(
        money_sum(F.when(cur, F.col("revenue"))).alias("revenue"),
        F.sum(F.when(cur, F.col("l_quantity"))).alias("units"),
        money_sum(F.when(cur, cost_factor * F.col("l_quantity") * F.col("p_retailprice"))).alias("cost"),
        money_sum(F.when(~cur, F.col("revenue"))).alias("prev_revenue")).filter(F.col("revenue").isNotNull())
    top = agg.orderBy(F.desc("revenue"), "product_id").limit(k)
    w = Window.orderBy(F.desc("revenue"), "product_id")   # k rows
    return top.select(
        F.row_number().over(w).cast("bigint").alias("rank"), "product_id", "product", "revenue", "units",
        F.round(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, 2).alias("margin_pct"),
        pct_change("revenue", "prev_revenue").alias("growth_pct"))


FUNNEL_STAGES = ("view", "click", "signup", "purchase")


def funnel(events: DataFrame, stages=FUNNEL_STAGES, unit=("user_id", "day"), strict: bool = True) -> DataFrame:
    """(stage_order, stage, count, conv_from_prev).

    Unit = (user, day). With ``strict`` a unit reaches stage k when it has events of the
    stages 1..k in this order, each later than the one before; other events may lie between
    (click, view, click reaches ``click`` by the second click). Without, it needs every
    stage 1..k at any time. conv_from_prev = round(count / previous * 100, 1).

    Strict matching takes the earliest event that continues the match: the time of stage k
    is the least one of its events after the time of stage k - 1. Each step is one join on
    the unit, whose partitioning the next step keeps: every event is shuffled once."""
    ev = events.select("user_id", "ts", "event_type").withColumn("day", F.to_date("ts")) \
        .filter(F.col("event_type").isin(*stages)).select(*unit, "ts", "event_type")
    known = None
    for u in unit:   # an unknown unit is none
        known = F.col(u).isNotNull() if known is None else known & F.col(u).isNotNull()
    ev = ev.filter(known)
    if strict:
        first = ev.filter(F.col("event_type") == stages[0])
        firsts = first.groupBy(*unit).agg(F.min("ts").alias("m0"))
        for i, s in enumerate(stages[1:], 1):
            times = [f"m{j}" for j in range(i)]
            step = ev.filter(F.col("event_type") == s).withColumnsRenamed({u: f"_{u}" for u in unit})
            later = (F.col("ts") > F.col(times[-1]))
            for u in unit:
                later = later & (F.col(u) == F.col(f"_{u}"))
            firsts = firsts.join(step, later, "left").groupBy(*unit, *times).agg(F.min("ts").alias(f"m{i}"))
    else:
        firsts = ev.groupBy(*unit).agg(*[F.min(F.when(F.col("event_type") == s, F.col("ts"))).alias(f"m{i}")
                                         for i, s in enumerate(stages)])
    reach = []
    cond = None
    for i in range(len(stages)):
        step = F.col(f"m{i}").isNotNull()
        cond = step if cond is None else cond & step
        reach.append(F.count(F.when(cond, 1)).alias(f"c{i}"))
    counts = firsts.agg(*reach)
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("stage_order"), F.lit(s).alias("stage"), F.col(f"c{i}").alias("count"))
        for i, s in enumerate(stages)])))
    return _conversion(rows)


def _conversion(rows: DataFrame) -> DataFrame:
    w = Window.orderBy("stage_order")   # one row per stage
    return rows.select("stage_order", "stage", "count",
                       F.round(safe_div(F.col("count") * 100.0, F.lag("count").over(w)), 1).alias("conv_from_prev"))


def regions(sales_g: DataFrame, period: int = 365) -> DataFrame:
    """Per region: revenue, customers, growth_pct; revenue descending."""
    as_of = as_of_date(sales_g, "o_orderdate")
    s = _two_periods(sales_g, "o_orderdate", as_of, period)
    agg = s.groupBy(F.col("r_name").alias("region")).agg(
        money_sum(F.when(F.col("k") == 0, F.col("revenue"))).alias("revenue"),
        F.count_distinct(F.when(F.col("k") == 0, F.col("o_custkey"))).alias("customers"),
        money_sum(F.when(F.col("k") == 1, F.col("revenue"))).alias("prev_revenue"))
    return agg.select("region", "revenue", "customers", pct_change("revenue", "prev_revenue").alias("growth_pct")) \
        .orderBy(F.desc("revenue"), "region")


def etl_sales_aggregation(sales_gp: DataFrame) -> DataFrame:
    """Nightly rollup day > region > brand: revenue, quantity, lines, level.

    level = grouping_id (0 = day+region+brand ... 7 = grand total). The fact rows
    are first summed per (day, region, brand), exactly and unrounded; only that
    table is expanded for the rollup."""
    detail = sales_gp.groupBy(day_start("o_orderdate").alias("day"), F.col("r_name").alias("region"), F.col("p_brand").alias("brand")).agg(
        F.sum(money("revenue")).alias("_revenue"), F.sum("l_quantity").alias("_quantity"), F.count(F.lit(1)).alias("_lines"))
    return detail.rollup("day", "region", "brand").agg(
        F.grouping_id().alias("level"), F.round(F.sum("_revenue"), 2).cast("double").alias("revenue"),
        F.sum("_quantity").alias("quantity"), F.sum("_lines").alias("lines"))


def write_sales_rollup(rollup: DataFrame, path: str) -> str:
    """Detail level partitioned by month (range reads prune folders); rows of a
    month go to one task each, so a folder holds few files."""
    detail = rollup.filter(F.col("level") == 0).withColumn("day", F.to_date("day"))
    detail = detail.withColumn("month", F.date_format("day", "yyyy-MM"))
    detail.repartition("month", "region").write.mode("overwrite").partitionBy("month").parquet(path)
    return path


def customer_rfm(orders: DataFrame) -> DataFrame:
    """(c_custkey, recency_days, frequency, monetary) per customer with orders."""
    as_of = as_of_date(orders, "o_orderdate")
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.datediff(F.lit(as_of.date()), F.to_date(F.max("o_orderdate"))).alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        money_sum("o_totalprice").alias("monetary"))


def customer_segmentation(rfm: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """K-means on standardised RFM: (c_custkey, recency_days, frequency, monetary, segment)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    cols = ["recency_days", "frequency", "monetary"]
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=cols, outputCol="_v", handleInvalid="skip"),
        StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True),
        KMeans(k=k, seed=seed, featuresCol="_z", predictionCol="segment")])
    model = pipe.fit(rfm)
    return model.transform(rfm).select("c_custkey", *cols, "segment")
