"""Ingestion jobs: landed REST payloads and SQL query results become stored,
profiled, catalogued datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.operators.profile import profile_dataset
from tessera.sources.catalog import profile_summary_json, register_datasets
from tessera.sources.files import read_json


def ingest_rest(spark: SparkSession, landed_json: str, name: str, store: str, catalog_path: str,
                schema: T.StructType | None = None, profile: bool = True, options: dict | None = None) -> DataFrame:
    """JSON records (lines or arrays) already landed by the fetcher -> Parquet dataset -> profile
    -> catalog row. Returns the stored dataset."""
    if options:
        reader = spark.read
        for k, v in options.items():
            reader = reader.option(k, v)
        df = reader.schema(schema).json(landed_json) if schema is not None else reader.json(landed_json)
    else:
        df = read_json(spark, landed_json, schema=schema)
    df.write.mode("overwrite").parquet(store)
    stored = spark.read.parquet(store)
    prof = {name: profile_summary_json(profile_dataset(stored))} if profile else None
    register_datasets(spark, catalog_path, [(name, "rest_api", store, stored)], prof)
    return stored


def ingest_sql(spark: SparkSession, query: str, name: str, store: str, catalog_path: str,
               connection_url: str | None = None, jdbc_options: dict | None = None, profile: bool = True) -> DataFrame:
    """Run ``query`` (passed through whole) -> Parquet dataset -> profile -> catalog.

    Parquet keeps types, nulls and line breaks inside text as they are.

    With ``connection_url`` the query runs in the source database over JDBC
    (``query`` option; add partitionColumn/lowerBound/upperBound/numPartitions
    with ``dbtable`` for parallel reads); otherwise on the session's tables
    through Catalyst."""
    if connection_url:
        reader = spark.read.format("jdbc").option("url", connection_url).option("query", query)
        for k, v in (jdbc_options or {}).items():
            reader = reader.option(k, v)
        result = reader.load()
    else:
        result = spark.sql(query)
    result.write.mode("overwrite").parquet(store)
    stored = spark.read.parquet(store)
    prof = {name: profile_summary_json(profile_dataset(stored))} if profile else None
    register_datasets(spark, catalog_path, [(name, "sql_database", store, stored)], prof)
    return stored
