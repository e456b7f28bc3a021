"""Dataset catalog: one append-only Parquet table of dataset records.

Row and column counts and the file size are taken once, at registration
(the catalog is never re-derived by re-reading every file); the schema is
stored as JSON text and parsed with ``from_json`` when needed.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("dataset_id string, name string, source_type string, file_path string, rows bigint, columns int, "
                  "size_bytes bigint, schema_json string, profile_json string, created_at timestamp_ntz")


def _totals(df: DataFrame, place: int, path: str | None) -> DataFrame:
    """(place, rows, size_bytes): counts and file lengths added up on the executors (contents are not read)."""
    rows = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(place).alias("place"), "rows")
    if not path:
        return rows.withColumn("size_bytes", F.lit(None).cast("bigint"))
    files = df.sparkSession.read.format("binaryFile").load(path).select("length")
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes")).select(F.lit(place).alias("place"), "size_bytes")
    return rows.join(size, "place")


def dataset_records(spark: SparkSession, datasets: list[tuple[str, str, str | None, DataFrame]],
                    profiles: dict[str, str] | None = None) -> DataFrame:
    """Catalog rows for several datasets: (name, source_type, path, df).

    All row counts and file sizes are computed in ONE job (a union of
    per-dataset totals). Every registration has its own id."""
    profiles = profiles or {}
    totals = None
    for i, (_, _, path, df) in enumerate(datasets):      # by place: two datasets may have one name
        c = _totals(df, i, path)
        totals = c if totals is None else totals.unionByName(c)
    found = {r["place"]: r for r in totals.collect()} if totals is not None else {}
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = []
    for i, (name, source_type, path, df) in enumerate(datasets):
        r = found[i]
        rows.append((uuid.uuid4().hex, name, source_type, path, int(r["rows"]), len(df.columns), r["size_bytes"],
                     df.schema.json(), profiles.get(name), now + dt.timedelta(microseconds=i)))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def register_datasets(spark: SparkSession, catalog_path: str, datasets, profiles=None) -> DataFrame:
    recs = dataset_records(spark, datasets, profiles)
    recs.write.mode("append").parquet(catalog_path)
    return recs


def latest(spark: SparkSession, catalog_path: str) -> DataFrame:
    """The newest registration of every dataset name."""
    c = spark.read.parquet(catalog_path)
    newest = F.max_by(F.struct(*c.columns), F.struct("created_at", "dataset_id"))
    return c.groupBy("name").agg(newest.alias("r")).select("r.*")


def list_datasets(spark: SparkSession, catalog_path: str) -> DataFrame:
    """Every dataset (its latest registration), newest first."""
    return latest(spark, catalog_path).orderBy(F.desc("created_at"), "name")


def export_dataset(spark: SparkSession, catalog_path: str, name: str) -> DataFrame:
    """Metadata, schema and profile of one dataset as one JSON document (nested objects, not JSON text)."""
    c = latest(spark, catalog_path).filter(F.col("name") == name)
    head = F.to_json(F.struct("name", "source_type", "file_path", "rows", "columns", "size_bytes", "created_at"))
    # schema and profile are JSON text already: put in as objects
    parts = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"schema":'), F.coalesce("schema_json", F.lit("null")),
                     F.lit(',"profile":'), F.coalesce("profile_json", F.lit("null")), F.lit("}"))
    return c.select("name", parts.alias("document"))


def profile_summary_json(profile_long: DataFrame) -> str:
    """A profile (long form) folded into one JSON text for the catalog row.

    Only used for small profiles (rows = columns x statistics)."""
    doc: dict = {}
    for r in profile_long.collect():
        sec = doc.setdefault(r["section"], {})
        key = r["column_name"] or "_table"
        sec.setdefault(key, {})[r["metric"]] = r["value"] if r["value"] is not None else r["text"]
    return json.dumps(doc, default=str)
