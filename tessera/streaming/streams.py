"""Structured Streaming jobs over event files.

Each job reads a directory of files as a stream (``readStream`` with a pinned
schema), aggregates with event-time watermarks, and writes to a sink in the
shared checkpoint folder with its own checkpoint location, so a restarted job
resumes exactly where it stopped (file source offsets + state store). Tests
and the query registry run them with ``trigger(availableNow=True)`` so each
can be compared with its batch twin.

Event time: ``events.ts`` is TIMESTAMP_NTZ, which watermarks reject; it is
cast to TIMESTAMP (session time zone UTC) on the way in and back to NTZ in
results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import hour_start, instant_to_ntz, ntz_lit, ntz_to_instant, safe_div, severity_from_z
from tessera.session import complete_folders, scratch_dir

# Source types a stream may be registered with.
STREAM_SOURCE_TYPES = ("kafka", "iot", "web_logs")
# Seconds between looks at a running query's progress.
PROGRESS_SECONDS = 2
# Micro-batches of an upsert sink after which its latest rows are written as a snapshot.
COMPACT_EVERY = 50


def register_stream_source(name: str, source_type: str, configuration: dict | None = None) -> dict:
    """Validate a stream source registration: kafka, iot and web_logs are
    accepted, anything else is rejected."""
    st = (source_type or "").lower()
    status = "registered" if st in STREAM_SOURCE_TYPES else "rejected"
    return {"name": name, "source_type": source_type, "configuration": dict(configuration or {}), "status": status}


def open_stream(spark: SparkSession, source: dict, schema: T.StructType) -> DataFrame:
    """Open a registered source: kafka through the Kafka connector (needs its
    jar on the classpath); iot / web_logs as a topic log (format "topic_log",
    read by offsets) or a directory of JSON or Parquet files with a pinned schema."""
    if source.get("status") != "registered":
        raise ValueError(f"source {source.get('name')} was rejected")
    conf = source["configuration"]
    if source["source_type"].lower() == "kafka":
        reader = spark.readStream.format("kafka")
        for k, v in conf.items():
            reader = reader.option(k, v)
        return reader.load()
    fmt = conf.get("format", "json")
    if fmt == "topic_log":
        from tessera.streaming.topic_log import read_log
        return read_log(spark, conf["path"], schema)
    reader = spark.readStream.schema(schema)
    for k, v in conf.items():
        if k not in ("format", "path"):
            reader = reader.option(k, v)
    return reader.format(fmt).load(conf["path"])


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", max_files: int | None = None,
                 glob: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files of a directory as a stream (default: ``{name}.parquet`` of
    ``sf_dir``); ts as TIMESTAMP.

    ``max_files`` bounds a micro-batch. A source whose files overlap in time
    must then get a watermark delay as long as the overlap, else rows of later
    files are late (``run_updates`` reports how many)."""
    if schema is None:
        schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob or f"{name}.parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    s = reader.parquet(sf_dir)
    if "ts" in s.columns:
        s = s.withColumn("ts", ntz_to_instant("ts"))
    return s


def run_available(query_df: DataFrame, out: str, mode: str = "append", fmt: str = "parquet",
                  checkpoint: str | None = None) -> str:
    """Run a streaming query over everything available, then stop."""
    ckpt = checkpoint or out + "-checkpoint"
    q = (query_df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return out


def run_foreach_batch(query_df: DataFrame, fn, checkpoint: str, mode: str = "append") -> int:
    """Run over everything available; returns the rows that state operators dropped as late."""
    q = (query_df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    late: dict = {}

    def note():   # recentProgress keeps the last 100 batches only
        for p in q.recentProgress:
            late[_field(p, "batchId", 0), _field(p, "timestamp", "")] = sum(
                int(op.get("numRowsDroppedByWatermark", 0)) for op in _field(p, "stateOperators", []))

    while not q.awaitTermination(PROGRESS_SECONDS):
        note()
    note()
    return sum(late.values())


def _field(progress, name: str, default):
    if isinstance(progress, dict):
        return progress.get(name, default)
    import json
    return json.loads(progress.json).get(name, default)


def run_updates(query_df: DataFrame, out: str, keys: list[str]) -> DataFrame:
    """Run in update mode into an upsert sink and return the latest row of each key.

    Each micro-batch writes the rows that changed, to a folder of its own
    (overwritten when the batch is replayed); reading takes the newest batch's
    row of a key. So windows that are still open are there as well, and a batch
    costs what it changes. Every ``COMPACT_EVERY`` batches the latest rows are written
    as a snapshot; reading starts from the newest one. Late rows are reported as a warning."""
    spark = query_df.sparkSession

    def keep(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if (epoch + 1) % COMPACT_EVERY == 0:
            latest_updates(batch.sparkSession, out, query_df.schema, keys, before=epoch) \
                .write.mode("overwrite").parquet(f"{out}-snapshots/upto={epoch}")

    late = run_foreach_batch(query_df, keep, out + "-checkpoint", mode="update")
    if late:
        warnings.warn(f"{late} rows came after their watermark and were dropped: choose a longer delay", stacklevel=2)
    return latest_updates(spark, out, query_df.schema, keys)


def newest_snapshot(spark: SparkSession, out: str, before: int | None) -> int | None:
    """The last micro-batch that a complete snapshot (older than ``before``) covers."""
    upto = complete_folders(spark, f"{out}-snapshots", "upto")
    return max((u for u in upto if before is None or u < before), default=None)


def latest_updates(spark: SparkSession, out: str, schema: T.StructType, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest row of each key of an upsert sink (null keys are keys): the newest snapshot and the batches after it
    (snapshots from ``before`` on are left out: a batch that is replayed writes its own anew)."""
    if not _exists(spark, out):
        return spark.createDataFrame([], schema)
    values = [f.name for f in schema.fields if f.name not in keys]
    full = T.StructType(schema.fields + [T.StructField("epoch", T.LongType())])
    r = spark.read.schema(full).parquet(out)
    upto = newest_snapshot(spark, out, before)
    if upto is not None:   # older folders are not read (the filter prunes them)
        r = r.filter(F.col("epoch") > upto).unionByName(
            spark.read.schema(schema).parquet(f"{out}-snapshots/upto={upto}").withColumn("epoch", F.lit(upto).cast("long")))
    newest = r.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
    return newest.select(*[F.col(f"_v.{f.name}").alias(f.name) if f.name in values else F.col(f.name) for f in schema.fields])


def event_window(events: DataFrame, seconds: int, delay: str):
    """The stream with its watermark, and the tumbling window of ts."""
    return events.withWatermark("ts", delay), F.window("ts", f"{seconds} seconds").alias("w")


def closed(window_end, newest_ts, delay: str):
    """Whether the watermark (newest event less the delay) has passed the window's end."""
    return window_end <= newest_ts - F.expr(f"INTERVAL {delay}")


def _ntz(c: str) -> F.Column:
    return instant_to_ntz(c)


# --------------------------------------------------------------------------
def stream_throughput(spark: SparkSession, sf_dir: str, window_seconds: int = 3600, *, watermark: str,
                      out: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """(window_start, window_end, events, rate_per_sec, closed) for every window that has events.

    ``watermark`` is the delay the source needs. Windows that it has not passed
    when the input is exhausted are there with ``closed`` false."""
    out = out or scratch_dir(spark, "throughput")
    src, w = event_window(source if source is not None else event_stream(spark, sf_dir), window_seconds, watermark)
    agg = src.groupBy(w).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"))
    r = run_updates(agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "newest"),
                    out, ["window_start", "window_end"])
    newest = F.max("newest").over(Window.partitionBy())      # one row per window of time: a small table
    return r.select(_ntz("window_start").alias("window_start"), _ntz("window_end").alias("window_end"), "events",
                    F.round(F.col("events") / float(window_seconds), 4).alias("rate_per_sec"),
                    closed(F.col("window_end"), newest, watermark).alias("closed"))


def stream_topic_rates(spark: SparkSession, sf_dir: str, window_seconds: int = 3600, *, watermark: str,
                       out: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Per topic over all windows: events, windows, rate_per_sec, share_pct,
    active_topics."""
    out = out or scratch_dir(spark, "topics")
    ev, w = event_window(source if source is not None else event_stream(spark, sf_dir), window_seconds, watermark)
    agg = ev.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"))
    r = run_updates(agg.select(F.col("w.start").alias("window_start"), "event_type", "events"), out, ["window_start", "event_type"])
    per = r.groupBy("event_type").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("windows"))
    w = Window.partitionBy()   # one row per topic: bounded
    return per.select(
        "event_type", "events", "windows",
        F.round(safe_div(F.col("events"), F.col("windows") * float(window_seconds)), 4).alias("rate_per_sec"),
        F.round(safe_div(F.col("events") * 100.0, F.sum("events").over(w)), 2).alias("share_pct"),
        F.count(F.lit(1)).over(w).alias("active_topics"))


# Keys over which the newest rows are kept, so that no task holds more than its share of a batch.
RECENT_SALTS = 32


def stream_recent(spark: SparkSession, sf_dir: str, n: int = 8, max_files: int | None = None, source: DataFrame | None = None,
                  state_dir: str | None = None) -> DataFrame:
    """The newest ``n`` events, newest first.

    The stream's own keyed state holds the newest ``n`` rows of each of
    ``RECENT_SALTS`` hash keys; the result is the newest ``n`` of these."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    state_dir = state_dir or scratch_dir(spark, "recent")
    ev = source if source is not None else event_stream(spark, sf_dir, max_files=max_files)
    schema = ev.schema
    salted = ev.withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(RECENT_SALTS)).cast("int"))
    salted = salted.select("_salt", F.unix_micros("ts").alias("_ts"), "event_id",
                           F.to_json(F.struct(*ev.columns), JSON_TS_OPTIONS).alias("_row"))

    def keep(key, frames, state):
        import pandas as pd
        held = pd.DataFrame(list(state.get[0]) if state.exists else [], columns=["_ts", "event_id", "_row"])
        for f in frames:
            held = pd.concat([held, f[["_ts", "event_id", "_row"]]]).sort_values(["_ts", "event_id"], ascending=False).head(n)
        state.update(([tuple(x) for x in held.itertuples(index=False)],))
        yield held.assign(_salt=key[0], _rank=range(len(held)))[["_salt", "_rank", "_ts", "event_id", "_row"]]

    item = "struct<_ts: bigint, event_id: bigint, _row: string>"
    out = salted.groupBy("_salt").applyInPandasWithState(
        keep, "_salt int, _rank int, _ts long, event_id long, _row string", f"held array<{item}>", "update", GroupStateTimeout.NoTimeout)
    kept = run_updates(out, state_dir, ["_salt", "_rank"])
    top = kept.orderBy(F.desc("_ts"), F.desc("event_id")).limit(n)
    return top.select(F.from_json("_row", schema, JSON_TS_OPTIONS).alias("r")).select("r.*").withColumn("ts", _ntz("ts"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Microsecond timestamps survive the JSON round trip.
JSON_TS_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                   "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def raw_event_lines(events: DataFrame, corrupt_every: int = 50) -> DataFrame:
    """JSON text per event; every ``corrupt_every``-th event id loses its
    closing brace (a malformed record)."""
    js = F.to_json(F.struct(*[F.col(c) for c in events.columns]), JSON_TS_OPTIONS)
    return events.select(F.when(F.col("event_id") % corrupt_every == 0, js.substr(F.lit(1), F.length(js) - 1))
                         .otherwise(js).alias("value"))


def schema_guard(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Parse JSON text with a pinned schema; rows that do not parse are kept
    with status 'quarantine' and their raw text, the rest are 'valid'."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType(), True)])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", **JSON_TS_OPTIONS}
    p = lines.select(F.from_json("value", full, opts).alias("r"),
                     "value")
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return p.select(*[F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields],
                    F.when(bad, "quarantine").otherwise("valid").alias("status"),
                    F.when(bad, F.col("value")).alias("raw"))


def stream_schema_guard(spark: SparkSession, sf_dir: str, landing: str | None = None) -> DataFrame:
    """Land events as JSON text, then run the guard as a stream over the
    landing folder; returns the parsed rows with their status."""
    landing = landing or scratch_dir(spark, "landing")
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    raw_event_lines(ev).write.mode("overwrite").text(landing)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ev.schema.fields])
    lines = spark.readStream.text(landing)
    out = landing + "-guarded"

    def split(batch: DataFrame, epoch: int):
        # two sinks: parsed rows and the quarantine of raw text; one folder per
        # epoch, overwritten when an epoch is replayed after a failure
        batch.persist()
        batch.filter(F.col("status") == "valid").drop("raw") \
            .write.mode("overwrite").parquet(f"{out}/valid/epoch={epoch}")
        batch.filter(F.col("status") == "quarantine").select("raw") \
            .write.mode("overwrite").parquet(f"{out}/quarantine/epoch={epoch}")
        batch.unpersist()

    run_foreach_batch(schema_guard(lines, schema), split, out + "-checkpoint")
    return guarded_outputs(spark, out, schema)


def guarded_outputs(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """Valid rows and quarantined raw records of a schema-guard run, as one
    table (status 'valid' / 'quarantine')."""
    valid_schema = T.StructType(schema.fields + [T.StructField("status", T.StringType())])
    if not _exists(spark, f"{out}/valid"):              # nothing arrived
        return spark.createDataFrame([], T.StructType(valid_schema.fields + [T.StructField("raw", T.StringType())]))
    valid = spark.read.schema(valid_schema).parquet(f"{out}/valid").drop("epoch")
    quarantine = spark.read.schema("raw string").parquet(f"{out}/quarantine").drop("epoch")
    bad = quarantine.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                            F.lit("quarantine").alias("status"), "raw")
    return valid.withColumn("raw", F.lit(None).cast("string")).unionByName(bad)


def stream_lag(spark: SparkSession, sf_dir: str, alert_seconds: float = 3600.0) -> DataFrame:
    """Event-time freshness per topic: (event_type, last_ts, events,
    lag_seconds = newest event overall - newest of the topic, alert).

    Lag in rows (newest offset less committed offset) is ``topic_log.consumer_lag``."""
    out = scratch_dir(spark, "lag")
    ev = event_stream(spark, sf_dir)
    agg = ev.groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))

    def keep(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(out)

    run_foreach_batch(agg, keep, out + "-checkpoint", mode="complete")
    r = spark.read.parquet(out)
    newest = F.max("last_ts").over(Window.partitionBy())   # one row per topic: bounded
    lag = (F.unix_micros(newest) - F.unix_micros("last_ts")) / 1e6      # instants: zone-free
    return r.select(
        "event_type", _ntz("last_ts").alias("last_ts"), "events", lag.alias("lag_seconds"),
        (lag > alert_seconds).alias("alert"))


def hourly_baseline(events: DataFrame, days: int = 15) -> DataFrame:
    """Static baseline per event type: mean and sample std of hourly counts in
    the first ``days`` days of the table."""
    import datetime as dt
    d0 = events.agg(F.to_date(F.min("ts"))).first()[0]                   # one scalar
    e = events.filter(F.col("ts") < ntz_lit(dt.datetime.combine(d0 + dt.timedelta(days=days), dt.time())))
    h = e.groupBy("event_type", hour_start("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("event_type").agg(F.avg("n").alias("baseline_mean"), F.stddev_samp("n").alias("baseline_std"))


def stream_anomalies(spark: SparkSession, sf_dir: str, *, watermark: str, source: DataFrame | None = None) -> DataFrame:
    """Hourly counts per event type, scored in the stream against a static baseline (a stream-static join
    in the streaming plan); the windows with |z| >= 2, open ones with ``closed`` false.

    Rows below the threshold are kept in the sink: a later update may take a window back below it."""
    static = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    ev, w = event_window(source if source is not None else event_stream(spark, sf_dir), 3600, watermark)
    agg = ev.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"))
    scored = agg.join(hourly_baseline(static), "event_type").select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events",
        F.round("baseline_mean", 4).alias("baseline_mean"), F.round("baseline_std", 4).alias("baseline_std"),
        F.round(F.try_divide(F.col("events") - F.col("baseline_mean"), F.col("baseline_std")), 4).alias("z_score"), "newest")
    r = run_updates(scored, scratch_dir(spark, "alerts"), ["window_start", "window_end", "event_type"])
    newest = F.max("newest").over(Window.partitionBy())      # one row per hour and event type: a small table
    return r.select("event_type", _ntz("window_start").alias("window_start"), "events", "baseline_mean", "baseline_std", "z_score",
                    closed(F.col("window_end"), newest, watermark).alias("closed")) \
        .withColumn("severity", severity_from_z("z_score")).filter(F.col("severity").isNotNull())


def stream_score(spark: SparkSession, stream: DataFrame, transform, out: str | None = None) -> DataFrame:
    """Apply a fitted model (any DataFrame -> DataFrame function) to a stream
    and append the scored rows."""
    out = out or scratch_dir(spark, "scored")
    run_available(transform(stream), out)
    return spark.read.parquet(out)


def stream_metrics_hourly(spark: SparkSession, sf_dir: str, *, watermark: str, approx: bool = False,
                          source: DataFrame | None = None) -> DataFrame:
    """Monitoring on the stream: per hour requests, errors, error_rate, p99 latency and ``closed``.

    The exact p99 is taken in two steps: the state counts rows by (hour, value), a
    row of state each, and the quantile is read from these counts afterwards.
    ``approx=True`` keeps one fixed-size sketch per hour instead."""
    from tessera.operators.quantiles import weighted_quantile
    out = scratch_dir(spark, "hourly")
    ev, w = event_window(source if source is not None else event_stream(spark, sf_dir), 3600, watermark)
    sums = [F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"),
            F.max("ts").alias("newest")]
    hour = [F.col("w.start").alias("hour"), F.col("w.end").alias("hour_end")]
    if approx:
        agg = ev.groupBy(w).agg(*sums, F.percentile_approx("value", 0.99, 10000).alias("p99"))
        r = run_updates(agg.select(*hour, "requests", "errors", "newest", "p99"), out, ["hour", "hour_end"])
    else:
        agg = ev.groupBy(w, "value").agg(*sums)
        c = run_updates(agg.select(*hour, "value", "requests", "errors", "newest"), out, ["hour", "hour_end", "value"])
        p99 = weighted_quantile(c.filter("value IS NOT NULL"), "value", "requests", 0.99, ["hour"]).select(
            F.col("hour").alias("_h"), F.col("quantile").alias("p99"))
        r = c.groupBy("hour", "hour_end").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"),
                                              F.max("newest").alias("newest"))
        r = r.join(p99, F.col("hour") == F.col("_h"), "left")
    newest = F.max("newest").over(Window.partitionBy())      # one row per hour: a small table
    return r.select(_ntz("hour").alias("hour"), "requests", "errors",
                    F.round(safe_div(F.col("errors") * 100.0, F.col("requests")), 2).alias("error_rate"),
                    F.round("p99", 4).alias("p99_latency"), closed(F.col("hour_end"), newest, watermark).alias("closed"))


def stream_alert_state(spark: SparkSession, sf_dir: str, derive, key: str = "alert_id",
                       order_cols=("ts", "event_id"), source: DataFrame | None = None,
                       state_dir: str | None = None) -> DataFrame:
    """Upsert by key, last write wins, on a stream of change records.

    ``derive`` maps the raw stream (ts as TIMESTAMP_NTZ) to change rows. The
    stream's own state holds the newest row of each key (``max_by``); a
    micro-batch writes only the keys that it changed."""
    state_dir = state_dir or scratch_dir(spark, "alert-state")
    ev = source if source is not None else event_stream(spark, sf_dir)
    changes = derive(ev.withColumn("ts", instant_to_ntz("ts")))
    values = [c for c in changes.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order_cols)).alias("_v"))
    return run_updates(newest.select(key, "_v.*"), state_dir, [key]).select(*changes.columns)
