"""Platform monitoring aggregates over a request/event log.

Test mapping on ``events``: request = any row, error = event_type 'error',
latency = value, node = user_id % 6.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import hour_start, micros_between, safe_div
from tessera.operators.quantiles import grouped_quantiles

NODES = 6




def _p99_method(approx: bool) -> str:
    return "sketch" if approx else "distributed"


def metrics_summary(events: DataFrame, approx: bool = False, with_p99: bool = True) -> DataFrame:
    """One row: requests, errors, error_rate (%, 2 dp, 0 without requests),
    p99_latency, events_per_min over the span of the log."""
    is_err = F.col("event_type") == "error"
    p99 = grouped_quantiles(events, "value", [0.99], method=_p99_method(approx)).first() if with_p99 else None
    a = events.agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(is_err, 1)).alias("errors"),
                   F.lit(p99["value"] if p99 else None).cast("double").alias("p99"),
                   F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    minutes = micros_between("t0", "t1") / 6e7
    return a.select("requests", "errors",
                    F.coalesce(F.round(safe_div(F.col("errors") * 100.0, F.col("requests")), 2), F.lit(0.0)).alias("error_rate"),
                    F.round("p99", 4).alias("p99_latency"),
                    F.round(safe_div(F.col("requests"), minutes), 2).alias("events_per_min"))


def metrics_hourly(events: DataFrame, approx: bool = False) -> DataFrame:
    """Per hour: requests, errors, error_rate (%), p99 latency."""
    is_err = F.col("event_type") == "error"
    ev = events.withColumn("hour", hour_start("ts"))
    h = ev.groupBy("hour").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(is_err, 1)).alias("errors"))
    p99 = grouped_quantiles(ev, "value", [0.99], ["hour"], method=_p99_method(approx)) \
        .select(F.col("hour").alias("_h"), F.col("value").alias("p99"))
    h = h.join(p99, F.col("hour").eqNullSafe(F.col("_h")), "left")      # events without a time are an hour of their own
    return h.select("hour", "requests", "errors",
                    F.round(safe_div(F.col("errors") * 100.0, F.col("requests")), 2).alias("error_rate"),
                    F.round("p99", 4).alias("p99_latency"))


def node_status(events: DataFrame, degraded_error_pct: float = 25.0, nodes: int = NODES) -> DataFrame:
    """Per node, over the node's last hour of traffic: requests, errors,
    error_rate, latency (mean value), status DEGRADED when error_rate exceeds
    ``degraded_error_pct`` (chosen rule) else ONLINE."""
    ev = events.select((F.col("user_id") % nodes).alias("node"), "ts", "event_type", "value")
    # one row per node: AQE broadcasts it where it is small, splits a busy node's join partition where not
    last = ev.groupBy("node").agg(F.max("ts").alias("last_seen"))
    j = ev.join(last, "node").filter(F.col("ts") > F.col("last_seen") - F.expr("INTERVAL 1 HOUR"))
    agg = j.groupBy("node", "last_seen").agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"),
        F.round(F.avg(F.col("value").cast("decimal(18,2)")), 2).cast("double").alias("latency_ms"))
    rate = F.round(safe_div(F.col("errors") * 100.0, F.col("requests")), 2)
    return agg.select("node", "last_seen", "requests", "errors", rate.alias("error_rate"), "latency_ms",
                      F.when(rate > degraded_error_pct, "DEGRADED").otherwise("ONLINE").alias("status"))


def node_summary(status: DataFrame) -> DataFrame:
    """One row: nodes, nodes_online, mean latency over nodes."""
    return status.agg(F.count(F.lit(1)).alias("nodes"),
                      F.count(F.when(F.col("status") == "ONLINE", 1)).alias("nodes_online"),
                      F.round(F.avg(F.col("latency_ms").cast("decimal(18,2)")), 2).cast("double").alias("mean_latency_ms"))


def uptime_percent(events: DataFrame, breach_error_pct: float = 25.0) -> DataFrame:
    """One row: hourly buckets, breached buckets (error rate above the
    threshold), uptime_pct = share of buckets without a breach (chosen rule)."""
    # only counts are needed: no latency quantiles
    is_err = F.col("event_type") == "error"
    h = events.groupBy(hour_start("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.count(F.when(is_err, 1)).alias("errors")) \
        .withColumn("error_rate", F.round(safe_div(F.col("errors") * 100.0, F.col("requests")), 2))
    return h.agg(F.count(F.lit(1)).alias("buckets"),
                 F.count(F.when(F.col("error_rate") > breach_error_pct, 1)).alias("breaches")) \
        .withColumn("uptime_pct", F.round(safe_div((F.col("buckets") - F.col("breaches")) * 100.0, F.col("buckets")), 2))


def latest_per_key(log: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Last write wins: the newest row per key by ``order_cols``.

    ``max_by`` over a struct is an ordinary aggregate, so it is combined
    map-side: a key with a third of all changes still ships one row per task."""
    value_cols = [c for c in log.columns if c != key]
    latest = log.groupBy(key).agg(F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_s"))
    return latest.select(key, "_s.*")


def alert_state(alert_log: DataFrame) -> DataFrame:
    """Current state per alert id from the change log (upsert by id)."""
    return latest_per_key(alert_log, "alert_id", ["ts", "event_id"])


def active_alerts(state: DataFrame) -> DataFrame:
    return state.filter(~F.col("resolved"))


def category_counts(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """Counts per category, zero-filled for listed categories that are absent;
    values outside the list are kept too."""
    spark = df.sparkSession
    cats = spark.createDataFrame([(c,) for c in categories], "category string")
    counts = df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    # The category list is a small parameter: broadcast.
    return counts.join(F.broadcast(cats), "category", "full").select(
        "category", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
