"""Topic logs: a shared folder that keeps rows by topic and number, read as a stream with offsets of its own.

``append`` writes a segment of Parquet files (a file holds rows of one topic) and then its
manifest: the files with the number of their first row, and how many rows each topic has had.
A segment exists once its manifest is complete, so a writer that is lost half-way leaves
nothing to see and the retry writes over it. One writer appends to a log at a time.

``TopicLog`` is a Python data source for ``readStream``: an offset is the last segment and the
rows of each topic up to it; the plan of a micro-batch reads only the manifests of its new
segments, and every file is a task of its own, so a hot topic is as many tasks as it has files.

``consume`` appends a stream to a table, a folder a micro-batch that is overwritten when
the batch is replayed, together with the position each topic has reached there;
``consumer_lag`` is a log's newest offset less that position, a topic each.

Null topics are a topic. Rows of a topic are numbered in the order of their files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessera.session import complete_folders, qualified, shared_fs
from tessera.streaming.streams import run_foreach_batch

MANIFEST = "topic string, path string, first long, rows long"    # path is null in the row of a topic's end
OFFSET = "topic_offset"


def segments(spark: SparkSession, log: str) -> int:
    """The number of complete segments."""
    return max(complete_folders(spark, f"{log}/manifests", "segment"), default=0)


def ends(spark: SparkSession, log: str) -> DataFrame:
    """(topic, latest_offset): the rows each topic has had."""
    k = segments(spark, log)
    if not k:
        return spark.createDataFrame([], "topic string, latest_offset long")
    return spark.read.schema(MANIFEST).parquet(f"{log}/manifests/segment={k}").filter("path IS NULL") \
        .select("topic", F.col("first").alias("latest_offset"))


def append(df: DataFrame, log: str, topic: str) -> int:
    """Add the rows of ``df`` as the next segment; returns its number."""
    spark, before = df.sparkSession, ends(df.sparkSession, log)
    k = segments(spark, log) + 1
    data = f"{qualified(spark, log)}/segments/segment={k}"
    df.withColumn("_topic", F.col(topic)).write.mode("overwrite").partitionBy("_topic").parquet(data)
    stored = spark.read.schema(df.schema).parquet(data)      # topics and row counts of a file: one column is read
    files = stored.groupBy(F.col(topic).cast("string").alias("topic"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    base = before.select(F.col("topic").alias("_t"), "latest_offset")
    # some files a topic and segment, not rows
    order = Window.partitionBy("topic").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(base, F.col("topic").eqNullSafe(F.col("_t")), "left").select(
        "topic", "path", (F.coalesce("latest_offset", F.lit(0)) + F.coalesce(F.sum("rows").over(order), F.lit(0))).alias("first"), "rows")
    new = placed.groupBy("topic").agg(F.max(F.col("first") + F.col("rows")).alias("first"))
    reached = before.select("topic", F.col("latest_offset").alias("first")).unionByName(new).groupBy("topic").agg(F.max("first").alias("first"))
    none = reached.select("topic", F.lit(None).cast("string").alias("path"), "first", F.lit(0).cast("long").alias("rows"))
    placed.unionByName(none).coalesce(1).write.mode("overwrite").parquet(f"{log}/manifests/segment={k}")
    return k


class FileRows(InputPartition):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first


class TopicLogReader(DataSourceStreamReader):
    def __init__(self, log: str, schema: T.StructType):
        self.log, self.schema = log, schema

    def _manifest(self, k: int) -> list[dict]:
        fs, base = shared_fs(f"{self.log}/manifests/segment={k}")
        return ds.dataset(base, filesystem=fs, format="parquet").to_table().to_pylist()

    def initialOffset(self) -> dict:
        return {"segment": 0, "rows": {}}

    def latestOffset(self) -> dict:
        fs, base = shared_fs(f"{self.log}/manifests")
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True))
        done = [int(f.base_name.split("=")[1]) for f in found if f.base_name.startswith("segment=")
                and fs.get_file_info(f"{f.path}/_SUCCESS").type == pyarrow.fs.FileType.File]
        k = max(done, default=0)
        # a topic is named by its JSON text: null and "null" differ
        rows = {json.dumps(r["topic"]): r["first"] for r in self._manifest(k) if r["path"] is None} if k else {}
        return {"segment": k, "rows": dict(sorted(rows.items()))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [FileRows(r["path"], r["first"]) for k in range(start["segment"] + 1, end["segment"] + 1)
                for r in self._manifest(k) if r["path"] is not None]

    def read(self, partition: FileRows) -> Iterator[pa.RecordBatch]:
        fs, path = shared_fs(partition.path)
        at, names = partition.first, [f.name for f in self.schema.fields if f.name != OFFSET]
        with fs.open_input_file(path) as file:
            for b in pq.ParquetFile(file).iter_batches(batch_size=10_000, columns=names):
                cols = {n: b.column(n) for n in names} | {OFFSET: pa.array(range(at, at + b.num_rows), pa.int64())}
                at += b.num_rows
                yield pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in self.schema.fields})

    def commit(self, end: dict) -> None:
        """Nothing is deleted: readers keep their positions in their own checkpoints."""


class TopicLog(DataSource):
    """``readStream.format("topic_log")`` with options ``path`` and ``row_schema`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> T.StructType:
        rows = T.StructType.fromJson(json.loads(self.options["row_schema"]))
        return T.StructType([*rows.fields, T.StructField(OFFSET, T.LongType())])

    def streamReader(self, schema: T.StructType) -> TopicLogReader:
        return TopicLogReader(self.options["path"], schema)


def read_log(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The rows of a log as a stream, with ``topic_offset`` (from 0 in each topic)."""
    spark.dataSource.register(TopicLog)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return spark.readStream.format("topic_log").option("path", qualified(spark, log)).option("row_schema", nullable.json()).load()


def consume(stream: DataFrame, out: str, topic: str) -> None:
    """Append what is new in ``stream`` to the table ``out`` and note the positions reached.

    A run that begins with the replay of a batch ends with it; the next one reads on."""

    def keep(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/rows/epoch={epoch}")
        stored.groupBy(F.col(topic).cast("string").alias("topic")).agg((F.max(OFFSET) + 1).alias("committed_offset")) \
            .write.mode("overwrite").parquet(f"{out}/positions/epoch={epoch}")

    run_foreach_batch(stream, keep, f"{out}-checkpoint")


def consumed(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows that ``consume`` has appended to ``out``."""
    if not complete_folders(spark, f"{out}/positions", "epoch"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out}/rows").select(*[f.name for f in schema.fields])


def consumer_lag(spark: SparkSession, log: str, out: str, alert_rows: int = 0) -> DataFrame:
    """(topic, latest_offset, committed_offset, lag, alert): rows of each topic that ``out`` does not have yet."""
    at = "topic string, committed_offset long"
    # the newest folder of each topic would do; positions only grow, so the largest is the newest
    if complete_folders(spark, f"{out}/positions", "epoch"):
        reached = spark.read.schema(at).parquet(f"{out}/positions").groupBy("topic").agg(F.max("committed_offset").alias("committed_offset"))
    else:
        reached = spark.createDataFrame([], at)
    reached = reached.select(F.col("topic").alias("_t"), F.col("committed_offset").alias("_c"))
    lag = F.col("latest_offset") - F.coalesce("_c", F.lit(0))
    return ends(spark, log).join(reached, F.col("topic").eqNullSafe(F.col("_t")), "left").select(
        "topic", "latest_offset", F.coalesce("_c", F.lit(0)).alias("committed_offset"), lag.alias("lag"), (lag > alert_rows).alias("alert"))
