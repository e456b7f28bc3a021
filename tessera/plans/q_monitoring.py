"""Monitoring queries over events (request = row, error = event_type 'error',
latency = value, node = user_id % 6) and the alert change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import monitoring as M
from tessera.plans import fixtures as fx
from tessera.plans.registry import register
from tessera.sources.files import table


@register("metrics_summary", """
SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
       coalesce(round(count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / nullif(count(*), 0), 2), 0.0) AS error_rate,
       round(quantile_cont(value, 0.99), 4) AS p99_latency,
       round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 0), 2) AS events_per_min
FROM events""")
def q_metrics_summary(spark, sf_dir):
    return M.metrics_summary(table(spark, sf_dir, "events"))


HOURLY_SQL = """
SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / nullif(count(*), 0), 2) AS error_rate,
       round(quantile_cont(value, 0.99), 4) AS p99_latency
FROM events GROUP BY 1"""


@register("metrics_hourly", HOURLY_SQL)
def q_metrics_hourly(spark, sf_dir):
    return M.metrics_hourly(table(spark, sf_dir, "events"))


@register("metrics_hourly_nulls", f"WITH events AS (SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts) FROM ({fx.EVENTS_NULLS_SQL}))"
          + HOURLY_SQL)
def q_metrics_hourly_nulls(spark, sf_dir):
    """Missing times, values and types: one row for the events without a time."""
    e = fx.events_nulls(spark, sf_dir)
    return M.metrics_hourly(e.withColumn("ts", F.when(F.col("event_id") % 13 != 0, F.col("ts"))))


NODE_SQL = """
WITH ev AS (SELECT user_id % 6 AS node, ts, event_type, value FROM events),
lst AS (SELECT node, max(ts) AS last_seen FROM ev GROUP BY 1),
g AS (SELECT node, last_seen, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
             CAST(round(avg(CAST(value AS DECIMAL(18,2))), 2) AS DOUBLE) AS latency_ms
      FROM ev JOIN lst USING (node) WHERE ts > last_seen - INTERVAL 1 HOUR GROUP BY 1, 2)
SELECT node, last_seen, requests, errors, round(errors * 100.0::DOUBLE / nullif(requests, 0), 2) AS error_rate, latency_ms,
       CASE WHEN round(errors * 100.0::DOUBLE / nullif(requests, 0), 2) > 25.0 THEN 'DEGRADED' ELSE 'ONLINE' END AS status
FROM g"""


@register("node_status", NODE_SQL)
def q_node_status(spark, sf_dir):
    return M.node_status(table(spark, sf_dir, "events"))


@register("node_summary", f"""
WITH ns AS ({NODE_SQL})
SELECT count(*) AS nodes, count(*) FILTER (WHERE status = 'ONLINE') AS nodes_online,
       CAST(round(avg(CAST(latency_ms AS DECIMAL(18,2))), 2) AS DOUBLE) AS mean_latency_ms FROM ns""")
def q_node_summary(spark, sf_dir):
    return M.node_summary(M.node_status(table(spark, sf_dir, "events")))


@register("uptime_percent", f"""
WITH h AS ({HOURLY_SQL})
SELECT count(*) AS buckets, count(*) FILTER (WHERE error_rate > 25.0) AS breaches,
       round((count(*) - count(*) FILTER (WHERE error_rate > 25.0)) * 100.0::DOUBLE / nullif(count(*), 0), 2) AS uptime_pct
FROM h""")
def q_uptime_percent(spark, sf_dir):
    return M.uptime_percent(table(spark, sf_dir, "events"))


ALERT_STATE_SQL = f"""
WITH al AS ({fx.ALERT_LOG_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, event_id DESC) AS rn FROM al)
SELECT alert_id, event_id, ts, severity, title, resolved FROM r WHERE rn = 1"""


@register("alert_state", ALERT_STATE_SQL)
def q_alert_state(spark, sf_dir):
    return M.alert_state(fx.alert_log(spark, sf_dir))


@register("active_alerts", f"WITH st AS ({ALERT_STATE_SQL}) SELECT * FROM st WHERE NOT resolved")
def q_active_alerts(spark, sf_dir):
    return M.active_alerts(M.alert_state(fx.alert_log(spark, sf_dir)))


CATEGORIES = ["signup", "click", "view", "purchase", "error", "refund"]


@register("category_counts", """
WITH cats AS (SELECT unnest(['signup', 'click', 'view', 'purchase', 'error', 'refund']) AS category),
c AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1)
SELECT coalesce(cats.category, c.category) AS category, CAST(coalesce(c.n, 0) AS BIGINT) AS "count"
FROM cats FULL OUTER JOIN c ON cats.category = c.category""")
def q_category_counts(spark, sf_dir):
    return M.category_counts(table(spark, sf_dir, "events"), "event_type", CATEGORIES)
