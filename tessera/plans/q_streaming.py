"""Streaming queries: each runs a Structured Streaming job to completion
(availableNow) over the events file and returns the sink contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import fixtures as fx
from tessera.plans.registry import register
from tessera.session import scratch_dir
from tessera.sources.files import table
from tessera.streaming import adaptive as AD
from tessera.streaming import streams as S
from tessera.streaming import topic_log as TL

# the delay of the events source: its files do not overlap in time
DELAY = "1 hour"
CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS closed"


@register("stream_throughput", f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) AS events, round(count(*) / 3600.0::DOUBLE, 4) AS rate_per_sec, {CLOSED}
FROM events GROUP BY 1, 2""")
def q_stream_throughput(spark, sf_dir):
    return S.stream_throughput(spark, sf_dir, watermark=DELAY)


@register("stream_topic_rates", """
WITH w AS (SELECT date_trunc('hour', ts) AS ws, event_type, count(*) AS n FROM events GROUP BY 1, 2),
p AS (SELECT event_type, sum(n) AS events, count(*) AS windows FROM w GROUP BY 1)
SELECT event_type, CAST(events AS BIGINT) AS events, windows,
       round(events / (windows * 3600.0::DOUBLE), 4) AS rate_per_sec,
       round(events * 100.0::DOUBLE / sum(events) OVER (), 2) AS share_pct, count(*) OVER () AS active_topics FROM p""")
def q_stream_topic_rates(spark, sf_dir):
    return S.stream_topic_rates(spark, sf_dir, watermark=DELAY)


@register("stream_recent", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 8")
def q_stream_recent(spark, sf_dir):
    return S.stream_recent(spark, sf_dir, n=8)


@register("stream_schema_guard", """
SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id END AS event_id,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS ts,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE props END AS props,
       CASE WHEN event_id % 50 = 0 THEN 'quarantine' ELSE 'valid' END AS status
FROM events""")
def q_stream_schema_guard(spark, sf_dir):
    return S.stream_schema_guard(spark, sf_dir).drop("raw")


@register("stream_lag", """
SELECT event_type, max(ts) AS last_ts, count(*) AS events,
       (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1e6 AS lag_seconds,
       (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 1e6 > 3600.0 AS alert
FROM events GROUP BY 1""")
def q_stream_lag(spark, sf_dir):
    return S.stream_lag(spark, sf_dir)


def _two_segments(spark, sf_dir):
    """A registered source over a topic log, its events in two parts (15 days and the rest), and a sink."""
    ev = table(spark, sf_dir, "events")
    cut = F.lit(ev.agg(F.date_add(F.to_date(F.min("ts")), 15).cast("timestamp_ntz")).first()[0])     # one scalar
    log = scratch_dir(spark, "log")
    source = S.register_stream_source("events", "web_logs", {"path": log, "format": "topic_log"})
    # events without time come with the second part
    first = F.coalesce(F.col("ts") < cut, F.lit(False))
    return source, log, scratch_dir(spark, "consumed"), ev.schema, ev.filter(first), ev.filter(~first)


@register("stream_source", "SELECT * FROM events")
def q_stream_source(spark, sf_dir):
    """Two runs over one checkpoint, the second part appended between: every row once."""
    source, log, out, schema, *parts = _two_segments(spark, sf_dir)
    for part in parts:
        TL.append(part, log, "event_type")
        TL.consume(S.open_stream(spark, source, schema), out, "event_type")
    return TL.consumed(spark, out, schema)


@register("stream_lag_offsets", """
WITH d0 AS (SELECT CAST(CAST(min(ts) AS DATE) + INTERVAL 15 DAY AS TIMESTAMP) AS cut FROM events)
SELECT event_type AS topic, count(*) AS latest_offset, count(*) FILTER (WHERE ts < cut) AS committed_offset,
       count(*) - count(*) FILTER (WHERE ts < cut) AS lag, count(*) - count(*) FILTER (WHERE ts < cut) > 0 AS alert
FROM events, d0 GROUP BY 1""")
def q_stream_lag_offsets(spark, sf_dir):
    """The second part has arrived, the consumer has stopped after the first."""
    source, log, out, schema, first, second = _two_segments(spark, sf_dir)
    TL.append(first, log, "event_type")
    TL.consume(S.open_stream(spark, source, schema), out, "event_type")
    TL.append(second, log, "event_type")
    return TL.consumer_lag(spark, log, out)


@register("stream_anomalies", f"""
WITH d0 AS (SELECT CAST(CAST(min(ts) AS DATE) + INTERVAL 15 DAY AS TIMESTAMP) AS cut FROM events),
bh AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events, d0 WHERE ts < cut GROUP BY 1, 2),
base AS (SELECT event_type, avg(n) AS m, stddev_samp(n) AS s FROM bh GROUP BY 1),
w AS (SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS events, {CLOSED} FROM events GROUP BY 1, 2),
z AS (SELECT w.event_type, w.window_start, w.events, round(m, 4) AS baseline_mean, round(s, 4) AS baseline_std,
             round((w.events - m) / nullif(s, 0), 4) AS z_score, closed FROM w JOIN base USING (event_type))
SELECT *, CASE WHEN abs(z_score) >= 6 THEN 'CRITICAL' WHEN abs(z_score) >= 3.8 THEN 'HIGH'
               WHEN abs(z_score) >= 3 THEN 'MEDIUM' WHEN abs(z_score) >= 2 THEN 'LOW' END AS severity
FROM z WHERE abs(z_score) >= 2""")
def q_stream_anomalies(spark, sf_dir):
    return S.stream_anomalies(spark, sf_dir, watermark=DELAY)


@register("stream_anomalies_adaptive", f"""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS events, {CLOSED} FROM events
           WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, CAST(coalesce(window_start - lag(window_start) OVER o > INTERVAL {AD.IDLE_HOURS} HOUR, false) AS INTEGER) AS anew
      FROM h WHERE closed WINDOW o AS (PARTITION BY event_type ORDER BY window_start)),
k AS (SELECT *, sum(anew) OVER (PARTITION BY event_type ORDER BY window_start) AS run FROM g),
s AS (SELECT event_type, window_start, events, count(*) OVER p AS hours, sum(events) OVER p AS s1, sum(events * events) OVER p AS s2
      FROM k WINDOW p AS (PARTITION BY event_type, run ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, s1 / nullif(hours, 0) AS m, CASE WHEN hours > 1 THEN sqrt((hours * s2 - s1 * s1) / (hours * (hours - 1))) END AS sd FROM s),
r AS (SELECT *, CASE WHEN hours >= {AD.LEAST_HOURS} THEN round((events - m) / nullif(sd, 0), 4) END AS z_score FROM z)
SELECT event_type, window_start, events, hours, round(m, 4) AS baseline_mean, round(sd, 4) AS baseline_std, z_score,
       CASE WHEN abs(z_score) >= 6 THEN 'CRITICAL' WHEN abs(z_score) >= 3.8 THEN 'HIGH'
            WHEN abs(z_score) >= 3 THEN 'MEDIUM' WHEN abs(z_score) >= 2 THEN 'LOW' END AS severity FROM r""")
def q_stream_anomalies_adaptive(spark, sf_dir):
    """Every closed hour against the hours of its type before it, learnt in the stream's own state."""
    return AD.adaptive_anomalies(spark, sf_dir, watermark=DELAY)


@register("stream_score")
def q_stream_score(spark, sf_dir):
    from tessera.operators import ml as ML
    from tessera.plans.q_ml import _clf
    run = _clf(spark, sf_dir)
    feats = run["features"]
    model = ML.scorer(run["model"])
    labels = F.array(*[F.lit(x) for x in ML._labels(run["model"])])

    def score(stream):
        od = fx.derive_orders_dummies(stream)
        # the fitted feature names carry the dummy levels: {column}_{level}
        cols = [F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("double").alias("o_orderkey"),
                F.col("o_custkey").cast("double").alias("o_custkey")]
        for f in feats:
            for c in ("o_orderstatus", "o_orderpriority"):
                if f.startswith(c + "_"):
                    cols.append(F.coalesce((F.col(c) == f[len(c) + 1:]).cast("double"), F.lit(0.0)).alias(f))
        x = od.select(*cols)
        return model.transform(ML.align_features(x, feats, keep=["key"])).select(
            F.col("key").alias("o_orderkey"), F.col("_pred").alias("prediction_index"),
            F.element_at(labels, F.col("_pred").cast("int") + 1).alias("prediction"))

    return S.stream_score(spark, S.event_stream(spark, sf_dir, name="orders"), score)


@register("stream_metrics_hourly", f"""
SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors,
       round(count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / nullif(count(*), 0), 2) AS error_rate,
       round(quantile_cont(value, 0.99), 4) AS p99_latency, {CLOSED}
FROM events GROUP BY 1""")
def q_stream_metrics_hourly(spark, sf_dir):
    return S.stream_metrics_hourly(spark, sf_dir, watermark=DELAY)


@register("stream_alert_state", f"""
WITH al AS ({fx.ALERT_LOG_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts DESC, event_id DESC) AS rn FROM al)
SELECT alert_id, event_id, ts, severity, title, resolved FROM r WHERE rn = 1""")
def q_stream_alert_state(spark, sf_dir):
    return S.stream_alert_state(spark, sf_dir, fx.derive_alert_log)
