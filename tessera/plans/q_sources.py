"""Source, sink and catalog queries (round trips through CSV / JSON, ingestion)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.session import scratch_dir
from tessera.sources import catalog as C
from tessera.sources import ingest as I
from tessera.sources.files import load_table, read_csv, read_json, table, write_csv, write_json

NTZ_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@register("read_csv", "SELECT * FROM customer")
def q_read_csv(spark, sf_dir):
    src = table(spark, sf_dir, "customer")
    path = write_csv(src, scratch_dir(spark, "csv"))
    return read_csv(spark, path, schema=src.schema)


@register("write_csv", "SELECT * FROM lineitem")
def q_write_csv(spark, sf_dir):
    src = table(spark, sf_dir, "lineitem")
    path = write_csv(src, scratch_dir(spark, "csv"))
    return read_csv(spark, path, schema=src.schema)


@register("read_json", "SELECT * FROM supplier")
def q_read_json(spark, sf_dir):
    src = table(spark, sf_dir, "supplier")
    path = write_json(src, scratch_dir(spark, "json"))
    return read_json(spark, path, schema=src.schema)


@register("write_json", "SELECT * FROM orders")
def q_write_json(spark, sf_dir):
    src = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "json")
    src.write.mode("overwrite").options(**NTZ_JSON).json(path)
    return spark.read.schema(src.schema).options(**NTZ_JSON).json(path)


@register("load_table", "SELECT * FROM nation")
def q_load_table(spark, sf_dir):
    return load_table(spark, f"{sf_dir.rstrip('/')}/nation.parquet")


@register("ingest_rest", "SELECT * FROM events")
def q_ingest_rest(spark, sf_dir):
    src = table(spark, sf_dir, "events")
    landed = scratch_dir(spark, "landed")
    src.write.mode("overwrite").options(**NTZ_JSON).json(landed)     # the landed REST payload
    base = scratch_dir(spark, "ingest")
    return I.ingest_rest(spark, landed, "events_api", base + "/data", base + "/catalog", schema=src.schema,
                         options=NTZ_JSON)


INGEST_QUERY = ("SELECT c_mktsegment, count(*) AS customers, min(c_acctbal) AS min_balance, "
                "max(c_acctbal) AS max_balance FROM customer GROUP BY c_mktsegment")


@register("ingest_sql", INGEST_QUERY)
def q_ingest_sql(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    base = scratch_dir(spark, "ingest")
    return I.ingest_sql(spark, INGEST_QUERY, "segments_sql", base + "/data", base + "/catalog")


@register("dataset_catalog", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS name, 'parquet' AS source_type, count(*) AS \"rows\", "
    f"CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS INTEGER) AS \"columns\" FROM {t}"
    for t in TABLES))
def q_dataset_catalog(spark, sf_dir):
    cat = scratch_dir(spark, "catalog")
    C.register_datasets(spark, cat, [(t, "parquet", f"{sf_dir.rstrip('/')}/{t}.parquet", table(spark, sf_dir, t))
                                     for t in TABLES])
    return C.list_datasets(spark, cat).select("name", "source_type", "rows", "columns")


@register("dataset_export", """
SELECT 'orders' AS name, count(*) AS "rows", 6 AS "columns", 6 AS n_fields, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total
FROM orders""")
def q_dataset_export(spark, sf_dir):
    """The export document of a dataset with a profile, read back from its JSON objects."""
    cat, orders = scratch_dir(spark, "catalog"), table(spark, sf_dir, "orders")
    total = orders.agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")).first()[0]
    C.register_datasets(spark, cat, [("orders", "parquet", f"{sf_dir.rstrip('/')}/orders.parquet", orders)],
                        {"orders": json.dumps({"sums": {"o_totalprice": total}})})
    doc = C.export_dataset(spark, cat, "orders")
    return doc.select(
        "name", F.get_json_object("document", "$.rows").cast("long").alias("rows"),
        F.get_json_object("document", "$.columns").cast("int").alias("columns"),
        F.size(F.from_json(F.get_json_object("document", "$.schema.fields"), "array<struct<name: string>>")).alias("n_fields"),
        F.get_json_object("document", "$.profile.sums.o_totalprice").cast("double").alias("total"))


@register("read_csv_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_read_csv_text(spark, sf_dir):
    """A table whose texts hold line breaks and quotes, through CSV and back."""
    src = table(spark, sf_dir, "documents")
    return read_csv(spark, write_csv(src, scratch_dir(spark, "csv")), schema=src.schema)


@register("read_csv_inferred", """
SELECT l_orderkey, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS l_quantity,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem""")
def q_read_csv_inferred(spark, sf_dir):
    """Types found without a schema although columns hold NA spellings."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    path = scratch_dir(spark, "csv")
    write_csv(li.select("l_orderkey", F.when(n == 2, "NA").otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
                        F.when(n == 3, "N/A").otherwise(F.col("l_extendedprice").cast("string")).alias("l_extendedprice"),
                        F.when(n == 1, "null").otherwise(F.col("l_returnflag")).alias("l_returnflag")), path)
    return read_csv(spark, path)


@register("read_json_array", "SELECT s_suppkey, s_name FROM supplier")
def q_read_json_array(spark, sf_dir):
    """A pretty-printed JSON array document, one file, through ``load_table``."""
    src = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = scratch_dir(spark, "json") + ".json"
    rows = src.select(F.to_json(F.struct("s_suppkey", "s_name"), {"pretty": "true"}).alias("r"), "s_suppkey")
    doc = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "r"))), lambda x: x["r"]), ",\n"),
                            F.lit("]")).alias("value"))
    doc.write.mode("overwrite").text(path)
    return load_table(spark, path)


@register("ingest_sql_documents", "SELECT * FROM documents")
def q_ingest_sql_documents(spark, sf_dir):
    """A query result whose texts hold line breaks, stored and read back whole."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    base = scratch_dir(spark, "ingest")
    return I.ingest_sql(spark, "SELECT * FROM documents", "documents_sql", base + "/data", base + "/catalog", profile=False)
