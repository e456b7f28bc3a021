"""Paging, search and row-level transform queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.exprs import day_start
from tessera.operators import frame_ops as FO
from tessera.plans.registry import register
from tessera.sources.files import table


@register("preview_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def q_preview_page(spark, sf_dir):
    return FO.preview_page(table(spark, sf_dir, "orders"), ["o_orderkey"], page=3, limit=50)


@register("keyset_page", """
SELECT * FROM orders WHERE o_orderkey > (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 99)
ORDER BY o_orderkey LIMIT 50""")
def q_keyset_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    after = o.orderBy("o_orderkey").offset(99).limit(1).first()["o_orderkey"]
    return FO.keyset_page(o, "o_orderkey", after=after, limit=50)


@register("row_search", """
SELECT * FROM customer WHERE
  coalesce(contains(lower(CAST(c_custkey AS VARCHAR)), 'building'), false) OR
  coalesce(contains(lower(c_name), 'building'), false) OR
  coalesce(contains(lower(CAST(c_nationkey AS VARCHAR)), 'building'), false) OR
  coalesce(contains(lower(CAST(c_acctbal AS VARCHAR)), 'building'), false) OR
  coalesce(contains(lower(c_mktsegment), 'building'), false)""")
def q_row_search(spark, sf_dir):
    return FO.row_search(table(spark, sf_dir, "customer"), "Building")


@register("row_search_name", """
SELECT * FROM part WHERE
  contains(lower(CAST(p_partkey AS VARCHAR)), 'widget') OR contains(lower(p_name), 'widget') OR
  contains(lower(p_brand), 'widget') OR contains(lower(p_type), 'widget') OR
  contains(lower(CAST(p_size AS VARCHAR)), 'widget') OR contains(lower(CAST(p_retailprice AS VARCHAR)), 'widget')""")
def q_row_search_name(spark, sf_dir):
    return FO.row_search(table(spark, sf_dir, "part"), "WIDGET")


@register("audit_filter", """
SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND contains(event_type, 'ur')""")
def q_audit_filter(spark, sf_dir):
    return FO.audit_filter(table(spark, sf_dir, "events"), "ts", "event_type", days=7, token="ur")


@register("audit_filter_all", "SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY")
def q_audit_filter_all(spark, sf_dir):
    return FO.audit_filter(table(spark, sf_dir, "events"), "ts", "event_type", days=30, token="all")


@register("text_filter", """
SELECT * FROM part WHERE coalesce(contains(lower(p_name), 'bolt'), false) OR coalesce(contains(lower(p_type), 'bolt'), false)""")
def q_text_filter(spark, sf_dir):
    return FO.text_filter(table(spark, sf_dir, "part"), ["p_name", "p_type"], "Bolt")


def _feed(spark, sf_dir):
    """A notification feed derived from events (severity, message, description, title)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "signup", "warning").otherwise(F.col("event_type")).alias("severity"),
        F.when(F.col("value") > 100, F.lit(None)).otherwise(F.col("props")).alias("message"),
        F.when(F.col("value") > 300, F.lit(None)).otherwise(F.col("event_type")).alias("description"),
        F.concat(F.lit("Event "), F.col("event_id").cast("string")).alias("title"))


@register("severity_normalize", """
WITH f AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'warning' ELSE event_type END AS severity,
                  CASE WHEN value > 100 THEN NULL ELSE props END AS message,
                  CASE WHEN value > 300 THEN NULL ELSE event_type END AS description,
                  'Event ' || CAST(event_id AS VARCHAR) AS title FROM events)
SELECT *, CASE WHEN severity = 'error' THEN 'critical' WHEN severity = 'warning' THEN 'warning' ELSE 'info' END AS level,
       coalesce(message, description, title) AS text FROM f""")
def q_severity_normalize(spark, sf_dir):
    return FO.severity_normalize(_feed(spark, sf_dir))


@register("numeric_coerce", """
WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type
                                               WHEN 2 THEN '' ELSE ' ' || CAST(user_id AS VARCHAR) END AS raw FROM events)
SELECT event_id, raw, CASE WHEN trim(raw) = '' THEN 0.0 ELSE TRY_CAST(trim(raw) AS DOUBLE) END AS as_number,
       CASE WHEN (CASE WHEN trim(raw) = '' THEN 0.0 ELSE TRY_CAST(trim(raw) AS DOUBLE) END) IS NULL THEN raw END AS as_text
FROM r""")
def q_numeric_coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.col("event_type")) \
        .when(k == 2, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    return FO.numeric_coerce(e.select("event_id", raw.alias("raw")), "raw")


@register("series_zip", """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n,
                  count(*) FILTER (WHERE value > 100) AS big FROM events GROUP BY 1, 2),
arr AS (SELECT event_type, list(day ORDER BY day) AS days, list(n ORDER BY day) AS counts,
               list(big ORDER BY day) FILTER (WHERE big > 0) AS bigs FROM d GROUP BY 1),
z AS (SELECT event_type, unnest(range(greatest(len(days), coalesce(len(bigs), 0)))) AS idx, days, counts, bigs FROM arr)
SELECT event_type, CAST(idx AS INTEGER) AS idx, CAST(days[idx + 1] AS TIMESTAMP) AS day,
       coalesce(CAST(counts[idx + 1] AS DOUBLE), 0.0) AS counts, coalesce(CAST(bigs[idx + 1] AS DOUBLE), 0.0) AS bigs FROM z""")
def q_series_zip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.groupBy("event_type", day_start("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 100, 1)).alias("big"))
    # One array element per day: arrays are bounded by the calendar span.
    arr = d.groupBy("event_type").agg(
        F.sort_array(F.collect_list(F.struct("day", "n"))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.col("big") > 0, F.struct("day", "big")))).alias("b"))
    arr = arr.select("event_type", F.col("s.day").alias("day"), F.col("s.n").alias("counts"),
                     F.col("b.big").alias("bigs"))
    return FO.series_zip(arr, "event_type", "day", ["counts", "bigs"])


@register("last_n_per_key", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 8""")
def q_last_n_per_key(spark, sf_dir):
    return FO.last_n_per_key(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], n=8)


@register("preview", """
SELECT ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'] AS headers,
       count(*) AS total, 2 AS page, 25 AS "limit", 25 AS n_rows, min(o_orderkey) FILTER (rn > 25 AND rn <= 50) AS first_key
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)""")
def q_preview(spark, sf_dir):
    """Headers, total and one page of the orders table."""
    p = FO.preview(table(spark, sf_dir, "orders"), ["o_orderkey"], page=2, limit=25)
    return p.select("headers", "total", "page", "limit", F.size("rows").alias("n_rows"),
                    F.get_json_object(F.element_at("rows", 1), "$.o_orderkey").cast("long").alias("first_key"))
