"""Derived inputs built from the test tables.

Each builder has a SQL twin (``*_SQL``) with the same semantics, used by the
DuckDB oracle. They change values, never drop rows: every query still reads
whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import hour_start, ntz_lit, spread
from tessera.sources.files import table


# --- events with injected nulls and a constant column -----------------------
def events_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id",
        F.when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"),
        "props",
        F.lit(1.0).alias("c"),
    )


EVENTS_NULLS_SQL = """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
       props, 1.0::DOUBLE AS c
FROM events"""


# --- events with duplicate rows ------------------------------------------------
def events_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.floor("value").cast("double").alias("value"))
    return e.unionByName(e.filter(F.col("user_id") % 10 == 0))


EVENTS_DUPS_SQL = """
SELECT user_id, event_type, floor(value)::DOUBLE AS value FROM events
UNION ALL
SELECT user_id, event_type, floor(value)::DOUBLE AS value FROM events WHERE user_id % 10 = 0"""


# --- orders with categorical nulls and a binary label -------------------------
def orders_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_orders_dummies(table(spark, sf_dir, "orders"))


def derive_orders_dummies(o: DataFrame) -> DataFrame:
    """The orders_dummies derivation on any orders frame (batch or stream)."""
    hole = F.col("o_orderkey") % 19 == 0
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(hole, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(hole, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        (F.col("o_totalprice") > 250000).cast("int").alias("label"),
    )


ORDERS_DUMMIES_SQL = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CAST(o_totalprice > 250000 AS INTEGER) AS label
FROM orders"""


# --- prompts: conversations with one intent keyword per conv_id % 8 -----------
PROMPT_PREFIXES = {
    0: "What drove revenue ",
    1: "Why is churn rising ",
    2: "Explain the spike ",
    3: "Forecast next month ",
    4: "How good is the model ",
    5: "Is the stream healthy ",
    6: "",
    7: "Forecast revenue for ",
}


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 8
    prefix = F.lit("")
    for key in sorted(PROMPT_PREFIXES, reverse=True):
        prefix = F.when(k == key, F.lit(PROMPT_PREFIXES[key])).otherwise(prefix)
    return c.select("conv_id", "turn", "role", F.concat(prefix, F.col("text")).alias("text"))


PROMPTS_SQL = "SELECT conv_id, turn, role, (CASE conv_id % 8 " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in PROMPT_PREFIXES.items()) + " END) || text AS text FROM conversations"


# --- sales: the star join ---------------------------------------------------
def sales(spark: SparkSession, sf_dir: str, customer: bool = False, part: bool = False,
          geo: bool = False, source=None) -> DataFrame:
    """lineitem ⋈ orders (+ customer, part, nation, region on request).

    Only the joins asked for are planned: an inner join is never removed by
    Catalyst, so callers pay for exactly the dimensions they use. nation and
    region are bounded by definition (25 and 5 rows) and are broadcast; part
    and customer grow with the data and are left to AQE, which broadcasts
    them only when their runtime size is below the threshold. ``source``
    (name -> DataFrame) reads a co-located layout instead of the files
    (see ``tessera.sources.layout``): bucketed lineitem and orders join
    without a shuffle.
    """
    get = source or (lambda t: table(spark, sf_dir, t))
    li = get("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    if source is None:
        # a fact scan thinner than the cluster is spread on the join key (no-op
        # when the files already give enough partitions; a bucketed layout
        # keeps its own partitioning)
        li = spread(li, ["l_orderkey"])
    o = get("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = li.join(o, li.l_orderkey == o.o_orderkey).drop("l_orderkey")
    df = df.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    if part:
        p = get("part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
        df = df.join(p, df.l_partkey == p.p_partkey).drop("p_partkey")
    if customer or geo:
        c = get("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        df = df.join(c, df.o_custkey == c.c_custkey).drop("c_custkey")
    if geo:
        n = get("nation").select("n_nationkey", "n_regionkey", "n_name")
        r = get("region").select("r_regionkey", "r_name")
        geo_dim = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
        df = df.join(F.broadcast(geo_dim), df.c_nationkey == geo_dim.n_nationkey).drop("n_nationkey")
    return df


def sales_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir, part=True)
    return s.select(
        F.col("l_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("revenue"),
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("transaction_date"),
    )


SALES_TRANSACTIONS_SQL = """
SELECT l.l_partkey AS product_id, p.p_name AS product_name,
       l.l_extendedprice * (1 - l.l_discount) AS revenue,
       o.o_orderkey AS order_id, o.o_orderdate AS transaction_date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey"""


# --- hourly metric series with one injected spike ----------------------------
SPIKE_HOUR_OFFSET = 400   # hours after the first event hour
SPIKE_FACTOR = 15


def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, bucket, value): hourly event count and total value per type.

    The total is an exact decimal sum rounded to whole units, so every series
    is integer-valued and trailing means over <= 24 points never sit on a
    rounding tie at 4 decimals (results do not depend on summation order).

    The count of every type is multiplied by 15 in one hour, 400 hours after
    the first event hour, so the detectors have something to find.
    """
    e = table(spark, sf_dir, "events")
    hourly = e.groupBy("event_type", hour_start("ts").alias("bucket")).agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.col("value").cast("decimal(18,2)")), 0).cast("double").alias("value_sum"))
    t0 = e.agg(hour_start(F.min("ts"))).first()[0]                 # one scalar
    spike = F.col("bucket") == ntz_lit(t0 + dt.timedelta(hours=SPIKE_HOUR_OFFSET))
    h = hourly
    counts = h.select(
        F.concat(F.col("event_type"), F.lit(".count")).alias("metric"), "bucket",
        (F.col("n") * F.when(spike, SPIKE_FACTOR).otherwise(1)).cast("double").alias("value"))
    avgs = h.select(
        F.concat(F.col("event_type"), F.lit(".value_sum")).alias("metric"), "bucket",
        F.col("value_sum").alias("value"))
    return counts.unionByName(avgs)


METRIC_SERIES_SQL = f"""
WITH hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n,
         CAST(round(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE) AS value_sum
  FROM events GROUP BY 1, 2),
start AS (SELECT date_trunc('hour', min(ts)) AS t0 FROM events)
SELECT event_type || '.count' AS metric, bucket,
       CAST(n * CASE WHEN bucket = t0 + INTERVAL {SPIKE_HOUR_OFFSET} HOUR THEN {SPIKE_FACTOR} ELSE 1 END AS DOUBLE) AS value
FROM hourly, start
UNION ALL
SELECT event_type || '.value_sum' AS metric, bucket, value_sum AS value FROM hourly"""


# --- daily revenue per market segment ----------------------------------------
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, day, orders, value): orders and revenue per day and segment."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("c_mktsegment").alias("series"), F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("orders"),
        F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("value"))


DAILY_SERIES_SQL = """
SELECT c.c_mktsegment AS series, CAST(o.o_orderdate AS DATE) AS day, count(*) AS orders,
       CAST(round(sum(CAST(o.o_totalprice AS DECIMAL(18,2))), 2) AS DOUBLE) AS value
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2"""


# --- baseline / current windows of events for drift --------------------------
DRIFT_SHIFT_TYPE = "purchase"
DRIFT_SHIFT_FACTOR = 1.5


def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events tagged ``window`` = baseline (first 15 days) or current (rest);
    current ``value`` of one event type is scaled by 1.5."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    d0 = e.agg(F.to_date(F.min("ts"))).first()[0]                 # one scalar
    j = e
    is_base = F.col("ts") < ntz_lit(dt.datetime.combine(d0 + dt.timedelta(days=15), dt.time()))
    return j.select(
        "event_id", "ts", "event_type",
        F.when(is_base, F.lit("baseline")).otherwise(F.lit("current")).alias("window"),
        F.when(~is_base & (F.col("event_type") == DRIFT_SHIFT_TYPE), F.col("value") * DRIFT_SHIFT_FACTOR)
         .otherwise(F.col("value")).alias("value"))


EVENTS_WINDOWS_SQL = f"""
SELECT event_id, ts, event_type,
       CASE WHEN ts < CAST(CAST(d0 AS DATE) + INTERVAL 15 DAY AS TIMESTAMP) THEN 'baseline' ELSE 'current' END AS "window",
       CASE WHEN NOT (ts < CAST(CAST(d0 AS DATE) + INTERVAL 15 DAY AS TIMESTAMP)) AND event_type = '{DRIFT_SHIFT_TYPE}'
            THEN value * {DRIFT_SHIFT_FACTOR} ELSE value END AS value
FROM events, (SELECT CAST(min(ts) AS DATE) AS d0 FROM events)"""


# --- alert change log derived from events ------------------------------------
def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert changes: each error event (re)opens the alert of its node and day,
    each purchase event on the same node and day resolves it.

    alert_id = node-{user_id % 6}-{yyyy-MM-dd}; rows (alert_id, event_id, ts,
    severity, title, resolved).
    """
    return derive_alert_log(table(spark, sf_dir, "events"))


def derive_alert_log(events: DataFrame) -> DataFrame:
    """The alert_log derivation on any events frame (batch or stream, ts NTZ)."""
    e = events.filter(F.col("event_type").isin("error", "purchase"))
    return e.select(
        F.format_string("node-%d-%s", F.col("user_id") % 6, F.date_format("ts", "yyyy-MM-dd")).alias("alert_id"),
        "event_id", "ts",
        F.when(F.col("value") > 100, F.lit("error")).otherwise(F.lit("warning")).alias("severity"),
        F.concat(F.lit("Errors on node "), (F.col("user_id") % 6).cast("string")).alias("title"),
        (F.col("event_type") == "purchase").alias("resolved"))


ALERT_LOG_SQL = """
SELECT printf('node-%d-%s', user_id % 6, strftime(ts, '%Y-%m-%d')) AS alert_id, event_id, ts,
       CASE WHEN value > 100 THEN 'error' ELSE 'warning' END AS severity,
       'Errors on node ' || CAST(user_id % 6 AS VARCHAR) AS title,
       event_type = 'purchase' AS resolved
FROM events WHERE event_type IN ('error', 'purchase')"""


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runs table derived from events, one run per event type and month, whose metrics SQL can express:
    share = the type's part of the month's events, mean = its mean value."""
    e = table(spark, sf_dir, "events")
    month = F.date_format("ts", "yyyy-MM")
    per_month = e.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("all"))
    g = e.groupBy("event_type", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("value").cast("decimal(18,4)")).cast("double").alias("mean"), F.max("ts").alias("created_at"))
    g = g.join(per_month, "month").withColumn("share", F.round(F.col("n") / F.col("all"), 6)).withColumn("mean", F.round("mean", 4))
    clf = F.col("event_type").isin("click", "view", "error")
    metrics = F.when(clf, F.create_map(F.lit("accuracy"), F.col("share"), F.lit("f1"), F.col("share") / 2)).otherwise(
        F.create_map(F.lit("r2"), 1 - F.col("share"), F.lit("rmse"), F.col("mean")))
    return g.select(
        F.md5(F.concat("event_type", "month")).alias("run_id"), F.concat(F.lit("model_"), "event_type").alias("model_name"),
        F.lit("random_forest").alias("model_type"), F.when(clf, "classification").otherwise("regression").alias("problem_type"),
        F.col("event_type").alias("target"), F.array(F.lit("value"), F.lit("user_id")).alias("features"),
        F.when(clf, "accuracy").otherwise("rmse").alias("metric_name"), F.when(clf, F.col("share")).otherwise(F.col("mean")).alias("metric_value"),
        metrics.alias("metrics"), F.expr("CAST(map() AS map<string,string>)").alias("params"), "created_at",
        F.lit(None).cast("string").alias("artifact"))


EVENT_RUNS_SQL = """
SELECT md5(event_type || strftime(ts, '%Y-%m')) AS run_id, 'model_' || event_type AS model_name, 'random_forest' AS model_type,
       CASE WHEN event_type IN ('click', 'view', 'error') THEN 'classification' ELSE 'regression' END AS problem_type,
       event_type AS target, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'accuracy' ELSE 'rmse' END AS metric_name,
       round(count(*) / any_value(total)::DOUBLE, 6) AS share, round(sum(CAST(value AS DECIMAL(18, 4)))::DOUBLE / count(value), 4) AS mean,
       CASE WHEN event_type IN ('click', 'view', 'error') THEN round(count(*) / any_value(total)::DOUBLE, 6)
            ELSE round(sum(CAST(value AS DECIMAL(18, 4)))::DOUBLE / count(value), 4) END AS metric_value, max(ts) AS created_at
FROM (SELECT *, count(*) OVER (PARTITION BY strftime(ts, '%Y-%m')) AS total FROM events) GROUP BY event_type, strftime(ts, '%Y-%m')"""
