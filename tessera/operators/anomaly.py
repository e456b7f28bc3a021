"""Anomaly detection on bucketed metric series (metric, bucket, value).

The detector is a trailing-window z-score: for each point, the mean and
sample std of the previous ``k`` points of the same metric. The window is
partitioned by metric over an already-bucketed series, so each partition
holds one row per time bucket of one metric: its size is bounded by the time
span, not by the raw event volume (a metric fed by a third of all events
still has one row per hour).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import micros_between, ntz_lit, safe_div, severity_from_z

TRAILING_POINTS = 24


def anomaly_zscore(series: DataFrame, k: int = TRAILING_POINTS, baseline: str = "trailing") -> DataFrame:
    """(metric, bucket, value, expected_value, std, z_score).

    ``baseline='trailing'``: the previous k points; ``'global'``: all points
    of the metric. z is null when the baseline has < 2 points or std 0."""
    if baseline == "global":
        w = Window.partitionBy("metric")
    else:
        w = Window.partitionBy("metric").orderBy("bucket").rowsBetween(-k, -1)
    mean, std, n = F.avg("value").over(w), F.stddev_samp("value").over(w), F.count("value").over(w)
    out = series.select("metric", "bucket", "value", mean.alias("_m"), std.alias("_s"), n.alias("_n"))
    z = F.when((F.col("_n") >= 2) & (F.col("_s") > 0), (F.col("value") - F.col("_m")) / F.col("_s"))
    return out.select("metric", "bucket", "value", F.round("_m", 4).alias("expected_value"),
                      F.round("_s", 4).alias("std"), F.round(z, 4).alias("z_score"))


def detect_anomalies(scored: DataFrame, open_hours: int = 24, investigating_hours: int = 72) -> DataFrame:
    """Points with a severity (|z| >= 2), with an id and a status.

    status (chosen rule): open when within ``open_hours`` of the newest
    bucket, investigating within ``investigating_hours``, else resolved."""
    newest = scored.agg(F.max("bucket")).first()[0]                # one scalar
    age_h = micros_between(F.col("bucket"), ntz_lit(newest)) / 3.6e9
    a = scored.withColumn("severity", severity_from_z("z_score")).filter(F.col("severity").isNotNull())
    return a.select(
        F.concat_ws("@", "metric", F.date_format("bucket", "yyyy-MM-dd'T'HH:mm")).alias("id"),
        "metric", "bucket", "value", "expected_value", "z_score", "severity",
        F.when(age_h <= open_hours, "open").when(age_h <= investigating_hours, "investigating")
         .otherwise("resolved").alias("status"))


def anomaly_severity(scored: DataFrame) -> DataFrame:
    return scored.select("metric", "bucket", "z_score", severity_from_z("z_score").alias("severity"))


def anomaly_deviation(anoms: DataFrame) -> DataFrame:
    """ratio = value / expected (2 dp) and pct = (value - expected) / expected * 100 (1 dp)."""
    return anoms.select(
        "id", "value", "expected_value",
        F.round(safe_div("value", "expected_value"), 2).alias("ratio"),
        F.round(safe_div(F.col("value") - F.col("expected_value"), F.col("expected_value")) * 100, 1).alias("pct"),
        F.when(F.col("value") >= F.col("expected_value"), "above").otherwise("below").alias("direction"))


def anomaly_filter(anoms: DataFrame, severity: str = "", status: str = "", limit: int = 50) -> DataFrame:
    """Severity compared upper-cased, status lower-cased; empty = no filter;
    newest first, at most ``limit`` rows (the API's page size)."""
    out = anoms
    if severity:
        out = out.filter(F.col("severity") == severity.upper())
    if status:
        out = out.filter(F.col("status") == status.lower())
    return out.orderBy(F.desc("bucket"), "id").limit(int(limit))


SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
STATUSES = ("open", "investigating", "resolved")


def anomaly_summary(anoms: DataFrame) -> DataFrame:
    """One row: total, zero-filled counts by severity and status, last_detected."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count(F.when(F.col("severity") == s, 1)).alias(s.lower()) for s in SEVERITIES]
    aggs += [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    aggs.append(F.max("bucket").alias("last_detected"))
    return anoms.agg(*aggs)


# Rarity phrases and recommended actions by severity.
RARE_PHRASE = "extremely rare event (<0.01% probability)"
COMMON_PHRASE = "statistically significant deviation"
ACTIONS = {
    "CRITICAL": "Escalate immediately to on-call SRE. Review affected service logs and consider rollback.",
    "HIGH": "Investigate affected service within 4 hours. Monitor for recurrence.",
    "MEDIUM": "Schedule review in next engineering stand-up.",
    "LOW": "Log for reference. Monitor passively.",
}


def anomaly_explain(anoms: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, severity, explanation) for the requested ids (all when None).

    Unknown ids give no row. Numbers are rounded before formatting so the text
    does not depend on the formatter's tie rule."""
    src = anoms if ids is None else anoms.join(ids.select("id").distinct(), "id")
    z1 = F.round("z_score", 1)
    phrase = F.when(F.abs("z_score") > 5, F.lit(RARE_PHRASE)).otherwise(F.lit(COMMON_PHRASE))
    action = F.lit(ACTIONS["LOW"])
    for sev in ("MEDIUM", "HIGH", "CRITICAL"):
        action = F.when(F.col("severity") == sev, F.lit(ACTIONS[sev])).otherwise(action)
    text = F.format_string(
        "Anomaly detected: %s at %s. Observed value: %s | Expected baseline: %s. "
        "Z-score of %.1f (%.1f sigma from mean, %s). Recommended action: %s",
        F.col("metric"), F.date_format("bucket", "yyyy-MM-dd HH:mm"),
        F.format_number(F.round("value", 2), 2), F.format_number(F.round("expected_value", 2), 2),
        z1, F.abs(z1), phrase, action)
    return src.select("id", "severity", text.alias("explanation"))
