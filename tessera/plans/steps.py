"""Steps of a batch run that are done once for the same inputs.

A step's version is a hash of its name, parameters, the versions of its input files and of the
steps before it. Each attempt writes to a folder of its own; when it is done, a one-row manifest
``steps/{name}/version={version}`` is written with the attempt's folder, and Spark's commit of
that write is the step's commit: a rerun takes the folder of a finished step and repeats a step
that was lost on the way. Nothing reads an attempt that no manifest names.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MANIFEST = "step string, version string, output string, inputs string, finished_at timestamp"


def files_version(spark: SparkSession, path: str) -> str:
    """A hash of the names, lengths and times of a table's files, added up on the executors (no contents are read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # decimals: a sum of 64-bit hashes does not overflow
    r = files.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")).alias("h")).first()
    return f"{r['n']}-{r['h']}"


class Steps:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.versions: dict[str, str] = {}
        self.ran: list[str] = []

    def _finished(self, path: str) -> str | None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(MANIFEST).parquet(path).first()["output"]     # one row

    def run(self, name: str, work: Callable[[str], None], after: tuple[str, ...] = (), **inputs) -> str:
        """The folder that ``work`` has filled, in this run or in an earlier one with the same inputs."""
        text = json.dumps({"inputs": inputs, "after": {a: self.versions[a] for a in after}}, sort_keys=True, default=str)
        version = hashlib.sha256(f"{name}\n{text}".encode()).hexdigest()[:16]
        self.versions[name] = version
        manifest = f"{self.base}/steps/{name}/version={version}"
        output = self._finished(manifest)
        if output is None:
            output = f"{self.base}/{name}/{version}-{uuid.uuid4().hex[:8]}"
            work(output)
            row = self.spark.range(1).select(
                F.lit(name).alias("step"), F.lit(version).alias("version"), F.lit(output).alias("output"),
                F.lit(text).alias("inputs"), F.current_timestamp().alias("finished_at"))
            row.coalesce(1).write.mode("overwrite").parquet(manifest)
            self.ran.append(name)
        return output
