"""Anomalies on arrival against a baseline that each key learns in the stream.

A first query counts events by hour and type and appends the hours that its watermark has closed
to a table; a second one streams that table through keyed state (Spark takes no state function
after an aggregation in one query). The state holds, for each event type, how many hours it has seen, their sum and sum of squares (whole numbers, so the
state does not depend on how the input was cut into batches) and the last hour. An hour is
scored against the hours before it, then joins them. A type that is idle for ``idle_hours``
starts anew: the gap is seen when its next hour arrives, and an event-time timer drops the
state when the watermark passes the gap, so idle types hold no state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions.exprs import instant_to_ntz, severity_from_z
from tessera.session import scratch_dir
from tessera.streaming.streams import event_stream, event_window, run_available

HOUR_MS = 3_600_000
#: Hours a baseline needs before it scores, and the gap after which it starts anew.
LEAST_HOURS, IDLE_HOURS = 24, 48

STATE = "hours long, total long, squares long, last long"
RESULT = ("event_type string, hour_ms long, events long, hours long, baseline_mean double, baseline_std double, z_score double")


def score_hours(least: int, idle_hours: int):
    """The state function: (event type, its closed hours, state) -> scored hours."""
    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        n, total, squares, last = state.get if state.exists else (0, 0, 0, None)
        arrived = sorted(pair for f in frames for pair in zip(f["hour_ms"].tolist(), f["events"].tolist(), strict=True))
        out = []
        for hour, events in arrived:
            if last is not None and hour - last > idle_hours * HOUR_MS:
                n = total = squares = 0
            mean = total / n if n else None
            spread = (n * squares - total * total) / (n * (n - 1)) if n > 1 else 0.0
            std = spread ** 0.5 if n > 1 else None
            z = (events - mean) / std if std and n >= least else None
            out.append((key[0], hour, events, n, mean, std, z))
            n, total, squares, last = n + 1, total + events, squares + events * events, hour
        state.update((n, total, squares, last))
        state.setTimeoutTimestamp(max(last + (idle_hours + 1) * HOUR_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_type", "hour_ms", "events", "hours", "baseline_mean", "baseline_std", "z_score"])

    return run


def adaptive_anomalies(spark: SparkSession, sf_dir: str, *, watermark: str, least_hours: int = LEAST_HOURS,
                       idle_hours: int = IDLE_HOURS, out: str | None = None, source: DataFrame | None = None,
                       limits: DataFrame | None = None) -> DataFrame:
    """(event_type, window_start, events, hours, baseline_mean, baseline_std, z_score, severity): every hour that the
    watermark has closed; z and severity are null for fewer than ``least_hours`` hours or without spread.

    ``limits`` (event_type, min_events), a static table, is joined in the streaming plan: hours
    of fewer events than their type's limit are neither scored nor learnt; types without a limit
    are left out. A run continues where the last one with the same ``out`` stopped."""
    out = out or scratch_dir(spark, "adaptive")
    ev, w = event_window(source if source is not None else event_stream(spark, sf_dir), 3600, watermark)
    hours = ev.filter(F.col("event_type").isNotNull()).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"))
    hours = hours.select(F.col("w.end").alias("closes"), F.unix_millis(F.col("w.start")).alias("hour_ms"), "event_type", "events")
    if limits is not None:
        hours = hours.join(limits.select("event_type", "min_events"), "event_type").filter(F.col("events") >= F.col("min_events")).drop("min_events")
    schema = hours.schema
    run_available(hours, f"{out}/hours")
    # hours closed later end later: nothing is late behind the last closed hour
    arrived = spark.readStream.schema(schema).parquet(f"{out}/hours").withWatermark("closes", "0 seconds")
    scored = arrived.groupBy("event_type").applyInPandasWithState(
        score_hours(least_hours, idle_hours), RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    run_available(scored, f"{out}/scored")
    r = spark.read.schema(RESULT).parquet(f"{out}/scored")
    return r.select("event_type", instant_to_ntz(F.timestamp_millis("hour_ms")).alias("window_start"), "events", "hours",
                    F.round("baseline_mean", 4).alias("baseline_mean"), F.round("baseline_std", 4).alias("baseline_std"),
                    F.round("z_score", 4).alias("z_score")).withColumn("severity", severity_from_z("z_score"))
