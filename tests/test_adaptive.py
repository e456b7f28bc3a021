"""The adaptive baseline against a plain loop: one file, split files, a restart, idle types; compacted sinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.streaming import adaptive as AD
from tessera.streaming import streams as S

DELAY = "2 hours"
D0 = dt.datetime(2024, 5, 1)


def table_rows():
    rng = random.Random(8)
    out = []
    for h in range(240):
        for kind, mean in (("a", 9), ("b", 4), ("c", 3)):
            if kind == "b" and 60 <= h < 130 or kind == "c" and h >= 70:     # b is idle for 70 hours, c ends
                continue
            n = 40 if (kind, h) in (("a", 200), ("b", 180)) else max(0, round(rng.gauss(mean, 2)))
            out += [(D0 + dt.timedelta(hours=h, seconds=rng.randint(0, 3599)), kind) for _ in range(n)]
    return out


def expected(events, least=24, idle=48):
    newest = max(t for t, _ in events)
    counts = {}
    for t, k in events:
        h = t.replace(minute=0, second=0)
        if h + dt.timedelta(hours=1) <= newest - dt.timedelta(hours=2):
            counts[k, h] = counts.get((k, h), 0) + 1
    out, seen = {}, {}
    for (k, h), n in sorted(counts.items()):
        past, last = seen.get(k, ([], None))
        if last and h - last > dt.timedelta(hours=idle):
            past = []
        z = None
        if len(past) > 1:
            mean = sum(past) / len(past)
            std = (sum((x - mean) ** 2 for x in past) / (len(past) - 1)) ** 0.5
            z = (n - mean) / std if std and len(past) >= least else None
        out[k, h] = (n, len(past), z)
        seen[k] = ([*past, n], h)
    return out


def check(got, want):
    have = {(r["event_type"], r["window_start"]): r for r in got.collect()}
    assert set(have) == set(want)
    for key, (n, hours, z) in want.items():
        r = have[key]
        assert (r["events"], r["hours"]) == (n, hours)
        assert (r["z_score"] is None) == (z is None) and (z is None or abs(r["z_score"] - z) < 1e-3)
    assert have["a", D0 + dt.timedelta(hours=200)]["severity"] == "CRITICAL"


def land(spark, events, folder, name):
    df = spark.createDataFrame(events, "ts timestamp_ntz, event_type string").coalesce(1)
    df.write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, **kw):
    schema = spark.createDataFrame([], "ts timestamp_ntz, event_type string").schema
    r = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    for k, v in kw.items():
        r = r.option(k, v)
    from tessera.functions.exprs import ntz_to_instant
    return r.parquet(str(folder)).withColumn("ts", ntz_to_instant("ts"))


def test_one_file_split_files_and_restart(spark, tmp_path):
    events = table_rows()
    want = expected(events)
    assert any(h == 0 for (k, t), (_, h, _) in want.items() if k == "b" and t > D0 + dt.timedelta(hours=120))   # b started anew
    land(spark, events, tmp_path / "one", "f")
    check(AD.adaptive_anomalies(spark, "", watermark=DELAY, source=stream(spark, tmp_path / "one"), out=str(tmp_path / "o1")), want)

    # six files by time, rows out of order inside, one file a micro-batch; the second half arrives after a restart
    rng = random.Random(1)
    events.sort()
    size = -(-len(events) // 6)
    for i in range(6):
        part = events[i * size:(i + 1) * size]
        rng.shuffle(part)
        land(spark, part, tmp_path / "many", f"f{i}")
        if i in (2, 5):
            got = AD.adaptive_anomalies(spark, "", watermark=DELAY, source=stream(spark, tmp_path / "many", maxFilesPerTrigger=1),
                                        out=str(tmp_path / "o2"))
    check(got, want)


def test_static_table_in_the_plan(spark, tmp_path):
    events = table_rows()
    land(spark, events, tmp_path / "one", "f")
    limits = spark.createDataFrame([("a", 8), ("b", 0), ("z", 1)], "event_type string, min_events int")
    got = AD.adaptive_anomalies(spark, "", watermark=DELAY, source=stream(spark, tmp_path / "one"), out=str(tmp_path / "o"), limits=limits)
    newest = max(t for t, _ in events)
    every = expected(events)
    kept = sorted((k, h) for (k, h), (n, _, _) in every.items() if k == "a" and n >= 8 or k == "b")
    assert sorted((r["event_type"], r["window_start"]) for r in got.collect()) == kept and newest


def test_sink_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT_EVERY", 2)
    events = sorted(table_rows())[:900]
    for i in range(5):
        land(spark, events[i * 180:(i + 1) * 180], tmp_path / "in", f"f{i}")
    agg = stream(spark, tmp_path / "in", maxFilesPerTrigger=1).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    out = str(tmp_path / "sink")
    got = S.run_updates(agg, out, ["event_type"])
    assert S.newest_snapshot(spark, out, None) == 3 and S.newest_snapshot(spark, out, 3) == 1
    want = {k: sum(1 for _, x in events if x == k) for k in "abc"}
    assert {r["event_type"]: r["n"] for r in got.collect()} == want
    files = got.inputFiles()
    assert not any(f"epoch={e}/" in f for f in files for e in (0, 1, 2, 3)) or "epoch" in got._jdf.queryExecution().optimizedPlan().toString()


def test_late_rows_of_more_batches_than_progress_keeps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PROGRESS_SECONDS", 0.3)
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")
    try:
        for i in range(8):   # each file after the first has one row far behind
            t = D0 + dt.timedelta(days=10 * i)
            land(spark, [(t, "a")] + ([(t - dt.timedelta(days=35), "a")] if i else []), tmp_path / "in", f"f{i}")
        ev, w = S.event_window(stream(spark, tmp_path / "in", maxFilesPerTrigger=1), 3600, "1 hour")
        agg = ev.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("s"), "event_type", "n")
        with pytest.warns(UserWarning) as said:
            got = S.run_updates(agg, str(tmp_path / "o"), ["s", "event_type"])
        dropped = 15 - sum(r["n"] for r in got.collect())
        assert dropped > 4 and any(str(w.message).startswith(f"{dropped} rows came after") for w in said)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
