"""Session construction and shared-folder helpers.

On a cluster the session comes from the launcher; we only read its settings.
``get_spark`` is for tests, benches and local runs and fills in settings that
are unset, never overriding what a cluster already configured.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every tessera job relies on. They are defaults only: a value already
# present in the session (cluster config, spark-submit --conf) wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # MIN/MAX/COUNT answered from Parquet footers (used for as_of dates).
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
    # remove reliable-checkpoint files once their RDD is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tessera", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _ensure_checkpoint_dir(active)
        return active
    master = master or os.environ.get("TESSERA_MASTER", "local[*]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "8g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        root = _ensure_checkpoint_dir(spark)
    return root.rstrip("/")


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Set a checkpoint folder only when the session has none and runs in one local
    process (tests); raise on a cluster."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, a plain one on the cluster's default file system as Spark resolves it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def complete_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``{name}=number`` below ``path`` whose writing has finished."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p(path)):
        return []
    found = [f.getPath() for f in fs.listStatus(p(path)) if f.getPath().getName().startswith(f"{name}=")]
    return sorted(int(f.getName().split("=")[1]) for f in found if fs.exists(p(f, "_SUCCESS")))


def shared_fs(uri: str):
    """(pyarrow file system, path) of a qualified path that driver and executors share."""
    from urllib.parse import unquote

    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", uri))
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    raise ValueError(f"{uri} names no file system: qualify it on the driver")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one run."""
    return f"{checkpoint_root(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
