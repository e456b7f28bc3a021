"""A topic log read as a stream by its offsets, over restarts and half-written segments."""

import ast
import json

import pyspark.sql.functions as F
import pytest

from tessera.streaming import streams as S
from tessera.streaming import topic_log as TL
from tests.helpers import rows

SCHEMA = "id long, kind string, x double"


@pytest.fixture()
def parts(spark):
    df = spark.range(600).select("id", F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 > 0, "hot").otherwise("a/b = c")).alias("kind"),
                                 (F.col("id") / 4).alias("x"))
    return df, [df.filter("id < 200").repartition(3), df.filter("id BETWEEN 200 AND 449").repartition(2), df.filter("id >= 450")]


def counts(df):
    return {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()}


def test_restarts_read_every_row_once(spark, tmp_path, parts):
    whole, pieces = parts
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    src = S.register_stream_source("s", "iot", {"path": log, "format": "topic_log"})
    TL.append(pieces[0], log, "kind")
    TL.consume(S.open_stream(spark, src, whole.schema), out, "kind")
    assert rows(TL.consumed(spark, out, whole.schema)) == rows(whole.filter("id < 200"))
    assert {r["lag"] for r in TL.consumer_lag(spark, log, out).collect()} == {0}
    TL.append(pieces[1], log, "kind")
    TL.append(pieces[2], log, "kind")
    want = counts(whole.filter("id >= 200"))
    lag = TL.consumer_lag(spark, log, out, alert_rows=100).collect()
    assert {r["topic"]: r["lag"] for r in lag} == want
    assert {r["topic"] for r in lag if r["alert"]} == {k for k, n in want.items() if n > 100}
    for _ in range(2):       # the second run finds nothing new
        TL.consume(S.open_stream(spark, src, whole.schema), out, "kind")
        assert rows(TL.consumed(spark, out, whole.schema)) == rows(whole)
        assert {r["lag"] for r in TL.consumer_lag(spark, log, out).collect()} == {0}


def test_offsets_number_each_topic_without_gaps(spark, tmp_path, parts):
    whole, pieces = parts
    log, sink = str(tmp_path / "log"), str(tmp_path / "sink")
    for p in pieces:
        TL.append(p, log, "kind")
    q = TL.read_log(spark, log, whole.schema).writeStream.format("parquet").option("checkpointLocation", sink + "-c") \
        .trigger(availableNow=True).start(sink)
    q.awaitTermination()
    got = spark.read.parquet(sink)
    per = got.groupBy("kind").agg(F.min(TL.OFFSET).alias("a"), F.max(TL.OFFSET).alias("b"), F.count_distinct(TL.OFFSET).alias("n"))
    want = counts(whole)
    assert {r["kind"]: (r["a"], r["b"], r["n"]) for r in per.collect()} == {k: (0, n - 1, n) for k, n in want.items()}
    # what Spark has committed is what the log's manifest says
    end = ast.literal_eval(q.lastProgress.sources[0].endOffset)      # the text of a dict
    assert {json.loads(k): n for k, n in end["rows"].items()} == want == {r["topic"]: r["latest_offset"] for r in TL.ends(spark, log).collect()}


def test_half_written_segment_is_not_seen(spark, tmp_path, parts):
    whole, pieces = parts
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    TL.append(pieces[0], log, "kind")
    pieces[1].write.parquet(f"{log}/segments/segment=2")                     # the writer is lost here
    TL.consume(TL.read_log(spark, log, whole.schema), out, "kind")
    assert TL.consumed(spark, out, whole.schema).count() == 200
    assert TL.append(pieces[1], log, "kind") == 2
    TL.consume(TL.read_log(spark, log, whole.schema), out, "kind")
    assert rows(TL.consumed(spark, out, whole.schema)) == rows(whole.filter("id < 450"))


def test_replayed_batch_overwrites(spark, tmp_path, parts):
    whole, pieces = parts
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    TL.append(pieces[0], log, "kind")
    TL.consume(TL.read_log(spark, log, whole.schema), out, "kind")
    (tmp_path / "out-checkpoint" / "commits" / "0").unlink()                 # written, not committed
    (tmp_path / "out-checkpoint" / "commits" / ".0.crc").unlink(missing_ok=True)
    TL.append(pieces[1], log, "kind")
    for n in (200, 450):     # the run that replays a batch ends with it
        TL.consume(TL.read_log(spark, log, whole.schema), out, "kind")
        assert rows(TL.consumed(spark, out, whole.schema)) == rows(whole.filter(f"id < {n}"))


def test_empty_log_and_empty_append(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = spark.createDataFrame([], SCHEMA).schema
    TL.consume(TL.read_log(spark, log, schema), out, "kind")
    assert TL.consumed(spark, out, schema).count() == 0 and TL.consumer_lag(spark, log, out).count() == 0
    TL.append(spark.createDataFrame([], SCHEMA), log, "kind")
    TL.append(spark.createDataFrame([(1, None, 1.0), (2, "null", None)], SCHEMA), log, "kind")
    TL.consume(TL.read_log(spark, log, schema), out, "kind")
    assert TL.consumed(spark, out, schema).count() == 2
    assert {r["topic"]: r["latest_offset"] for r in TL.ends(spark, log).collect()} == {None: 1, "null": 1}


def test_one_name_twice_in_the_catalog(spark):
    from tessera.sources.catalog import dataset_records
    got = dataset_records(spark, [("x", "csv", None, spark.range(3)), ("x", "csv", None, spark.range(7))])
    assert sorted(r["rows"] for r in got.collect()) == [3, 7]
