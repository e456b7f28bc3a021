"""Anomaly queries over the hourly metric series derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import anomaly as AN
from tessera.plans import fixtures as fx
from tessera.plans.registry import register

MS = f"ms AS ({fx.METRIC_SERIES_SQL})"

Z_SQL = f"""
WITH {MS},
w AS (SELECT metric, bucket, value,
        avg(value) OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS m,
        stddev_samp(value) OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS s,
        count(value) OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS n
      FROM ms),
z AS (SELECT metric, bucket, value, round(m, 4) AS expected_value, round(s, 4) AS std,
        round(CASE WHEN n >= 2 AND s > 0 THEN (value - m) / s END, 4) AS z_score FROM w)"""

SEV = ("CASE WHEN abs(z_score) >= 6 THEN 'CRITICAL' WHEN abs(z_score) >= 3.8 THEN 'HIGH' "
       "WHEN abs(z_score) >= 3 THEN 'MEDIUM' WHEN abs(z_score) >= 2 THEN 'LOW' END")

ANOMS_SQL = Z_SQL + f""",
nw AS (SELECT max(bucket) AS newest FROM z),
an AS (SELECT metric || '@' || strftime(bucket, '%Y-%m-%dT%H:%M') AS id, metric, bucket, value, expected_value, z_score,
         {SEV} AS severity,
         CASE WHEN (epoch_us(newest) - epoch_us(bucket)) / 3.6e9 <= 24 THEN 'open'
              WHEN (epoch_us(newest) - epoch_us(bucket)) / 3.6e9 <= 72 THEN 'investigating' ELSE 'resolved' END AS status
       FROM z, nw WHERE {SEV} IS NOT NULL)"""


def _scored(spark, sf_dir):
    return AN.anomaly_zscore(fx.metric_series(spark, sf_dir), k=24)


def _anoms(spark, sf_dir):
    return AN.detect_anomalies(_scored(spark, sf_dir))


@register("anomaly_zscore", Z_SQL + "\nSELECT * FROM z")
def q_anomaly_zscore(spark, sf_dir):
    return _scored(spark, sf_dir)


@register("anomaly_zscore_global", f"""
WITH {MS},
w AS (SELECT metric, bucket, value, avg(value) OVER (PARTITION BY metric) AS m,
        stddev_samp(value) OVER (PARTITION BY metric) AS s, count(value) OVER (PARTITION BY metric) AS n FROM ms)
SELECT metric, bucket, value, round(m, 4) AS expected_value, round(s, 4) AS std,
       round(CASE WHEN n >= 2 AND s > 0 THEN (value - m) / s END, 4) AS z_score FROM w""")
def q_anomaly_zscore_global(spark, sf_dir):
    return AN.anomaly_zscore(fx.metric_series(spark, sf_dir), baseline="global")


@register("anomaly_severity", Z_SQL + f"\nSELECT metric, bucket, z_score, {SEV} AS severity FROM z")
def q_anomaly_severity(spark, sf_dir):
    return AN.anomaly_severity(_scored(spark, sf_dir))


@register("anomaly_detect", ANOMS_SQL + "\nSELECT * FROM an")
def q_anomaly_detect(spark, sf_dir):
    return _anoms(spark, sf_dir)


@register("anomaly_deviation", ANOMS_SQL + """
SELECT id, value, expected_value, round(value / nullif(expected_value, 0), 2) AS ratio,
       round((value - expected_value) / nullif(expected_value, 0) * 100, 1) AS pct,
       CASE WHEN value >= expected_value THEN 'above' ELSE 'below' END AS direction FROM an""")
def q_anomaly_deviation(spark, sf_dir):
    return AN.anomaly_deviation(_anoms(spark, sf_dir))


@register("anomaly_filter", ANOMS_SQL + """
SELECT * FROM an WHERE severity = 'HIGH' ORDER BY bucket DESC, id LIMIT 50""")
def q_anomaly_filter(spark, sf_dir):
    return AN.anomaly_filter(_anoms(spark, sf_dir), severity="high", status="", limit=50)


@register("anomaly_filter_status", ANOMS_SQL + """
SELECT * FROM an WHERE status = 'resolved' ORDER BY bucket DESC, id LIMIT 50""")
def q_anomaly_filter_status(spark, sf_dir):
    return AN.anomaly_filter(_anoms(spark, sf_dir), severity="", status="RESOLVED", limit=50)


@register("anomaly_summary", ANOMS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical,
       count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
       count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE status = 'open') AS open,
       count(*) FILTER (WHERE status = 'investigating') AS investigating,
       count(*) FILTER (WHERE status = 'resolved') AS resolved, max(bucket) AS last_detected FROM an""")
def q_anomaly_summary(spark, sf_dir):
    return AN.anomaly_summary(_anoms(spark, sf_dir))


EXPLAIN_SQL = ANOMS_SQL + f"""
SELECT id, severity,
  printf('Anomaly detected: %s at %s. Observed value: %s | Expected baseline: %s. Z-score of %s (%s sigma from mean, %s). Recommended action: %s',
    metric, strftime(bucket, '%Y-%m-%d %H:%M'), format('{{:,.2f}}', round(value, 2)), format('{{:,.2f}}', round(expected_value, 2)),
    format('{{:.1f}}', round(z_score, 1)), format('{{:.1f}}', abs(round(z_score, 1))),
    CASE WHEN abs(z_score) > 5 THEN '{AN.RARE_PHRASE}' ELSE '{AN.COMMON_PHRASE}' END,
    CASE severity WHEN 'CRITICAL' THEN '{AN.ACTIONS["CRITICAL"]}' WHEN 'HIGH' THEN '{AN.ACTIONS["HIGH"]}'
                  WHEN 'MEDIUM' THEN '{AN.ACTIONS["MEDIUM"]}' ELSE '{AN.ACTIONS["LOW"]}' END) AS explanation
FROM an WHERE severity IN ('HIGH', 'CRITICAL')"""


@register("anomaly_explain", EXPLAIN_SQL)
def q_anomaly_explain(spark, sf_dir):
    a = _anoms(spark, sf_dir)
    ids = a.filter(F.col("severity").isin("HIGH", "CRITICAL")).select("id")
    return AN.anomaly_explain(a, ids)
