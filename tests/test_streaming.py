"""Stream = batch: each streaming job against its batch twin, also with the
input split into several files whose rows are out of order inside a file."""

import pyspark.sql.functions as F
import pytest
from pyspark.sql import Window

from tessera.operators import monitoring as M
from tessera.streaming import streams as S
from tests.helpers import rows

SF = "/root/testdata/sf0.01"


DELAY = "1 hour"


def batch_windows(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    import datetime as dt
    mx = e.agg(F.max("ts")).first()[0]
    h = e.groupBy(F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("events"))
    h = h.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 1 HOUR"))
    return h.withColumn("closed", F.col("window_end") <= F.lit(mx - dt.timedelta(hours=1)))


def files(df, folder, n):
    """``n`` Parquet files in one folder; ``df`` has a column part (0..n-1)."""
    import glob
    import shutil
    flat = folder / "flat"
    flat.mkdir()
    for k in range(n):
        d = folder / f"c{k}"
        df.filter(F.col("part") == k).drop("part").orderBy(F.rand(k)).coalesce(1).write.parquet(str(d))
        shutil.copy(glob.glob(str(d / "*.parquet"))[0], flat / f"part-{k}.parquet")
    return str(flat)


def by_time(e, n):
    return e.withColumn("part", F.ntile(n).over(Window.orderBy("ts")) - 1)


COLS = ["window_start", "window_end", "events", "closed"]


def test_throughput_stream_equals_batch(spark):
    s = S.stream_throughput(spark, SF, watermark=DELAY)
    assert s.agg(F.sum("events")).first()[0] == 10000 and s.filter("NOT closed").count() > 0
    assert rows(s.select(*COLS)) == rows(batch_windows(spark).select(*COLS))


def test_throughput_split_files_out_of_order(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    flat = files(by_time(e, 4), tmp_path, 4)
    stream = S.event_stream(spark, flat, glob="part-*.parquet", schema=e.schema, max_files=1)
    s = S.stream_throughput(spark, SF, watermark=DELAY, source=stream)
    assert rows(s.select(*COLS)) == rows(batch_windows(spark).select(*COLS))


def test_files_that_overlap_in_time_lose_no_rows(spark, tmp_path):
    """Split by key: every file spans the whole month."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    flat = files(e.withColumn("part", F.col("event_id") % 4), tmp_path, 4)
    whole = S.stream_throughput(spark, SF, watermark=DELAY, source=S.event_stream(spark, flat, glob="part-*.parquet", schema=e.schema))
    assert rows(whole.select(*COLS)) == rows(batch_windows(spark).select(*COLS))
    one_by_one = S.event_stream(spark, flat, glob="part-*.parquet", schema=e.schema, max_files=1)
    s = S.stream_throughput(spark, SF, watermark="40 days", source=one_by_one)
    assert rows(s.select("window_start", "events")) == rows(whole.select("window_start", "events"))


def test_late_rows_are_reported(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    flat = files(e.withColumn("part", F.col("event_id") % 4), tmp_path, 4)
    one_by_one = S.event_stream(spark, flat, glob="part-*.parquet", schema=e.schema, max_files=1)
    with pytest.warns(UserWarning, match="rows came after their watermark"):
        S.stream_throughput(spark, SF, watermark=DELAY, source=one_by_one).count()


def test_recent_equals_batch(spark):
    s = S.stream_recent(spark, SF, n=8)
    b = spark.read.parquet(f"{SF}/events.parquet").orderBy(F.desc("ts"), F.desc("event_id")).limit(8)
    assert rows(s) == rows(b)


def test_lag_equals_batch(spark):
    s = S.stream_lag(spark, SF)
    e = spark.read.parquet(f"{SF}/events.parquet")
    b = e.groupBy("event_type").agg(F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))
    assert rows(s.select("event_type", "last_ts", "events")) == rows(b)


def test_schema_guard_quarantines_broken_records(spark):
    g = S.stream_schema_guard(spark, SF)
    n_bad = spark.read.parquet(f"{SF}/events.parquet").filter(F.col("event_id") % 50 == 0).count()
    assert g.filter("status = 'quarantine'").count() == n_bad
    assert g.filter("status = 'quarantine' AND raw IS NULL").count() == 0
    assert g.filter("status = 'valid' AND event_id IS NULL").count() == 0


def test_alert_state_last_write_wins(spark):
    import datetime as dt
    log = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1, 1), False), ("a", 2, dt.datetime(2024, 1, 1, 2), True),
                                 ("b", 3, dt.datetime(2024, 1, 1, 1), False)],
                                "alert_id string, event_id long, ts timestamp_ntz, resolved boolean")
    st = {r["alert_id"]: r["resolved"] for r in M.alert_state(log).collect()}
    assert st == {"a": True, "b": False}
    assert [r["alert_id"] for r in M.active_alerts(M.alert_state(log)).collect()] == ["b"]


def test_recent_survives_restart(spark, tmp_path):
    """Two runs on one checkpoint: the second (new files only) still merges
    with the state the first run left on storage."""
    import glob
    import shutil
    e = spark.read.parquet(f"{SF}/events.parquet")
    src = tmp_path / "w"
    e.repartition(4, "event_id").write.parquet(str(tmp_path / "parts"))
    files = sorted(glob.glob(str(tmp_path / "parts" / "*.parquet")))
    src.mkdir()
    for f in files[:2]:
        shutil.copy(f, src)
    state = str(tmp_path / "state")
    S.stream_recent(spark, SF, n=8, source=S.event_stream(spark, str(src), glob="*.parquet", schema=e.schema),
                    state_dir=state)
    for f in files[2:]:
        shutil.copy(f, src)
    got = S.stream_recent(spark, SF, n=8, source=S.event_stream(spark, str(src), glob="*.parquet", schema=e.schema),
                          state_dir=state)
    b = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(8)
    assert rows(got) == rows(b)


def test_registered_iot_source_streams_json(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    land = tmp_path / "iot"
    e.limit(500).write.json(str(land))
    src = S.register_stream_source("sensors", "iot", {"path": str(land), "format": "json"})
    st = S.open_stream(spark, src, e.schema)
    assert st.isStreaming
    q = st.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")) \
        .trigger(availableNow=True).start(str(tmp_path / "sink"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 500
    with pytest.raises(ValueError):
        S.open_stream(spark, S.register_stream_source("x", "mqtt"), e.schema)


def test_stream_score_equals_batch_predictions(spark):
    import __spark_entry__ as se
    small = "/root/testdata/sf0.001"
    s = se.queries()["stream_score"](spark, small).select("o_orderkey", "prediction")
    b = se.queries()["predict_batch"](spark, small).select("o_orderkey", "prediction")
    assert rows(s) == rows(b)


def test_alert_state_stream_equals_batch_across_restart(spark, tmp_path):
    import glob
    import shutil

    from tessera.plans import fixtures as fx
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(4, "event_id").write.parquet(str(tmp_path / "parts"))
    files = sorted(glob.glob(str(tmp_path / "parts" / "*.parquet")))
    src = tmp_path / "w"
    src.mkdir()
    state = str(tmp_path / "state")
    for batch in (files[:2], files[2:]):
        for f in batch:
            shutil.copy(f, src)
        got = S.stream_alert_state(spark, SF, fx.derive_alert_log, state_dir=state,
                                   source=S.event_stream(spark, str(src), glob="*.parquet", schema=e.schema))
    want = M.alert_state(fx.alert_log(spark, SF))
    assert rows(got) == rows(want)


def test_stream_anomalies_split_files_equal_single_file(spark, tmp_path):
    """Time-ordered files, shuffled rows inside each: the same alerts as one file."""
    e = spark.read.parquet(f"{SF}/events.parquet")
    flat = files(by_time(e, 3), tmp_path, 3)
    split = S.stream_anomalies(spark, SF, watermark=DELAY,
                               source=S.event_stream(spark, flat, glob="part-*.parquet", schema=e.schema, max_files=1))
    assert rows(split) == rows(S.stream_anomalies(spark, SF, watermark=DELAY))


def test_stream_metrics_hourly_split_files(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    flat = files(by_time(e, 3), tmp_path, 3)
    split = S.stream_metrics_hourly(spark, SF, watermark=DELAY,
                                    source=S.event_stream(spark, flat, glob="part-*.parquet", schema=e.schema, max_files=1))
    whole = S.stream_metrics_hourly(spark, SF, watermark=DELAY)
    assert rows(split) == rows(whole)
    sketch = S.stream_metrics_hourly(spark, SF, watermark=DELAY, approx=True)
    assert rows(sketch.select("hour", "requests", "errors")) == rows(whole.select("hour", "requests", "errors"))
