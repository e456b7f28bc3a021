"""Business analytics queries over the sales star schema and events."""

from __future__ import annotations

from tessera.operators.sql_top_products import nl_sql_top_products
from tessera.plans import fixtures as fx
from tessera.plans.registry import register
from tessera.sources.files import table


@register("nl_sql_top_products", f"""
WITH st AS ({fx.SALES_TRANSACTIONS_SQL})
SELECT product_id, product_name,
       CAST(round(sum(CAST(revenue AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_revenue,
       count(order_id) AS order_count
FROM st WHERE transaction_date >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY
GROUP BY product_id, product_name ORDER BY total_revenue DESC, product_id LIMIT 10""")
def q_nl_sql_top_products(spark, sf_dir):
    from pyspark.sql import functions as F
    as_of = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]   # newest order date
    return nl_sql_top_products(spark, fx.sales_transactions(spark, sf_dir), days=30, k=10, as_of=as_of)


# ---------------------------------------------------------------------------
from tessera.operators import analytics as A  # noqa: E402
from tessera.sources.files import table  # noqa: E402

REV = "l_extendedprice * (1 - l_discount)"


def _msum(expr: str, flt: str | None = None) -> str:
    f = f" FILTER (WHERE {flt})" if flt else ""
    return f"CAST(round(sum(CAST({expr} AS DECIMAL(18,4))){f}, 2) AS DOUBLE)"


def _pct(cur: str, prev: str) -> str:
    return f"round(({cur} - {prev}) / nullif({prev}, 0) * 100, 2)"


@register("pct_change", f"""
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_msum(REV)} AS revenue
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT year, revenue, lag(revenue) OVER (ORDER BY year) AS prev_revenue,
       round((revenue - lag(revenue) OVER (ORDER BY year)) / nullif(lag(revenue) OVER (ORDER BY year), 0) * 100, 2) AS change_pct
FROM y""")
def q_pct_change(spark, sf_dir):
    return A.revenue_by_year(fx.sales(spark, sf_dir))


def _kpi_sql(p: int) -> str:
    def per(c, i, a="a"):
        return f"{c} > {a} - INTERVAL {p * (i + 1)} DAY AND {c} <= {a} - INTERVAL {p * i} DAY"
    score = "least(10, floor(value / 10))"
    metrics = [
        ("revenue", "revenue_0", "revenue_1", "true"),
        ("orders", "orders_0", "orders_1", "true"),
        ("customers", "customers_0", "customers_1", "true"),
        ("new_customers", "new_0", "new_1", "true"),
        ("avg_order_value", "round(revenue_0 / nullif(orders_0, 0), 2)", "round(revenue_1 / nullif(orders_1, 0), 2)", "true"),
        ("churn_rate", "round(lost_0 * 100.0::DOUBLE / nullif(customers_1, 0), 2)",
         "round(lost_1 * 100.0::DOUBLE / nullif(customers_2, 0), 2)", "false"),
        ("conversion_rate", "conv_0", "conv_1", "true"),
        ("nps", "nps_0", "nps_1", "true"),
    ]
    rows = "\nUNION ALL\n".join(
        f"SELECT '{m}' AS metric, CAST({c} AS DOUBLE) AS value, CAST({pv} AS DOUBLE) AS prev, {h} AS hib FROM one"
        for m, c, pv, h in metrics)
    return f"""
WITH b AS (SELECT max(o_orderdate) AS a FROM orders),
o AS (SELECT o_orderkey, o_custkey, o_orderdate,
        CASE WHEN {per('o_orderdate', 0)} THEN 0 WHEN {per('o_orderdate', 1)} THEN 1 WHEN {per('o_orderdate', 2)} THEN 2 END AS k
      FROM orders, b WHERE o_orderdate > a - INTERVAL {3 * p} DAY),
rev AS (SELECT {_msum(REV, 'k = 0')} AS revenue_0, {_msum(REV, 'k = 1')} AS revenue_1
        FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE k < 2),
cnt AS (SELECT count(*) FILTER (WHERE k = 0) AS orders_0, count(*) FILTER (WHERE k = 1) AS orders_1 FROM o),
pc AS (SELECT o_custkey, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS in0, max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS in1,
              max(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS in2 FROM o GROUP BY 1),
cust AS (SELECT sum(in0) AS customers_0, sum(in1) AS customers_1, sum(in2) AS customers_2,
                sum(CASE WHEN in1 = 1 AND in0 = 0 THEN 1 ELSE 0 END) AS lost_0,
                sum(CASE WHEN in2 = 1 AND in1 = 0 THEN 1 ELSE 0 END) AS lost_1 FROM pc),
fst AS (SELECT o_custkey, min(o_orderdate) AS fd FROM orders GROUP BY 1),
nw AS (SELECT count(*) FILTER (WHERE {per('fd', 0)}) AS new_0, count(*) FILTER (WHERE {per('fd', 1)}) AS new_1 FROM fst, b),
eb AS (SELECT max(ts) AS ea FROM events),
ev AS (SELECT user_id, ts, event_type, value,
         CASE WHEN {per('ts', 0, 'ea')} THEN 0 WHEN {per('ts', 1, 'ea')} THEN 1 END AS k
       FROM events, eb WHERE ts > ea - INTERVAL {2 * p} DAY),
dd AS (SELECT k, user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS viewed,
              max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS bought FROM ev GROUP BY 1, 2, 3),
conv AS (SELECT round(sum(CASE WHEN k = 0 AND viewed = 1 THEN bought END) * 100.0::DOUBLE / nullif(sum(CASE WHEN k = 0 THEN viewed END), 0), 2) AS conv_0,
                round(sum(CASE WHEN k = 1 AND viewed = 1 THEN bought END) * 100.0::DOUBLE / nullif(sum(CASE WHEN k = 1 THEN viewed END), 0), 2) AS conv_1 FROM dd),
nps AS (SELECT round((count(*) FILTER (WHERE k = 0 AND {score} >= 9) - count(*) FILTER (WHERE k = 0 AND {score} <= 6)) * 100.0::DOUBLE
                     / nullif(count(*) FILTER (WHERE k = 0), 0), 2) AS nps_0,
               round((count(*) FILTER (WHERE k = 1 AND {score} >= 9) - count(*) FILTER (WHERE k = 1 AND {score} <= 6)) * 100.0::DOUBLE
                     / nullif(count(*) FILTER (WHERE k = 1), 0), 2) AS nps_1 FROM ev),
one AS (SELECT * FROM rev, cnt, cust, nw, conv, nps),
r AS ({rows})
SELECT metric, {p} AS period_days, value, prev, {_pct('value', 'prev')} AS change_pct,
       CASE WHEN value > prev THEN 'up' ELSE 'down' END AS trend,
       CASE WHEN hib THEN coalesce(value > prev, false) ELSE NOT coalesce(value > prev, false) END AS is_positive
FROM r"""


def _kpi(p):
    def run(spark, sf_dir):
        return A.kpi_summary(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
                             table(spark, sf_dir, "events"), period=p)
    return run


register("kpi_summary", _kpi_sql(30))(_kpi(30))
register("kpi_summary_7d", _kpi_sql(7))(_kpi(7))
register("kpi_summary_365d", _kpi_sql(365))(_kpi(365))


def _ts_sql(metric: str) -> str:
    if metric in ("revenue", "customers"):
        val = _msum(REV) if metric == "revenue" else "CAST(count(DISTINCT o_custkey) AS DOUBLE)"
        src = "lineitem JOIN orders ON l_orderkey = o_orderkey" if metric == "revenue" else "orders"
        return f"""
WITH b AS (SELECT max(o_orderdate) AS a FROM orders),
d AS (SELECT CAST(o_orderdate AS DATE) AS day, {val} AS value FROM {src}, b
      WHERE o_orderdate > a - INTERVAL 90 DAY GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(CAST(a AS DATE) - INTERVAL 89 DAY, CAST(a AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT CAST(cal.day AS TIMESTAMP) AS day, coalesce(d.value, 0.0) AS value FROM cal LEFT JOIN d USING (day)"""
    head = """
WITH b AS (SELECT max(ts) AS a FROM events),
ev AS (SELECT user_id, ts, event_type FROM events, b WHERE ts >= CAST(CAST(a AS DATE) AS TIMESTAMP) - INTERVAL 90 DAY),
cal AS (SELECT CAST(unnest(generate_series(CAST(a AS DATE) - INTERVAL 89 DAY, CAST(a AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM b)"""
    if metric == "events":
        d = "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY 1"
    elif metric == "api_requests":
        d = "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1"
    else:
        d = """SELECT n.day, round(count(*) FILTER (WHERE a2.user_id IS NULL) * 100.0::DOUBLE / count(*), 2) AS value
FROM (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) AS day FROM ev) n
LEFT JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM ev) a2 ON a2.user_id = n.user_id AND a2.day = n.day
GROUP BY 1"""
    return head + f",\nd AS ({d})\nSELECT CAST(cal.day AS TIMESTAMP) AS day, coalesce(d.value, 0.0) AS value FROM cal LEFT JOIN d USING (day)"


def _ts(metric):
    def run(spark, sf_dir):
        return A.metric_timeseries(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"),
                                   table(spark, sf_dir, "events"), metric=metric, days=90)
    return run


register("metric_timeseries", _ts_sql("revenue"))(_ts("revenue"))
for _m in ("customers", "events", "api_requests", "churn"):
    register(f"metric_timeseries_{_m}", _ts_sql(_m))(_ts(_m))


def _two(p: int, extra_join: str, cols: str) -> str:
    return f"""
WITH b AS (SELECT max(o_orderdate) AS a FROM orders),
s AS (SELECT {cols}, {REV} AS revenue,
        CASE WHEN o_orderdate > a - INTERVAL {p} DAY AND o_orderdate <= a THEN 0 ELSE 1 END AS k
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey {extra_join}, b
      WHERE o_orderdate > a - INTERVAL {2 * p} DAY)"""


@register("segments", _two(365, "JOIN customer ON o_custkey = c_custkey", "c_mktsegment, o_custkey") + f""",
g AS (SELECT c_mktsegment AS segment, count(DISTINCT CASE WHEN k = 0 THEN o_custkey END) AS customers,
             {_msum('revenue', 'k = 0')} AS revenue, {_msum('revenue', 'k = 1')} AS prev_revenue FROM s GROUP BY 1)
SELECT segment, customers, coalesce(revenue, 0.0) AS revenue,
       round(revenue * 100.0::DOUBLE / nullif(sum(revenue) OVER (), 0), 1) AS revenue_share,
       round(revenue / nullif(customers, 0), 2) AS avg_ltv, {_pct('revenue', 'prev_revenue')} AS growth_pct FROM g""")
def q_segments(spark, sf_dir):
    return A.segments(fx.sales(spark, sf_dir, customer=True), period=365)


@register("top_products", _two(365, "JOIN part ON l_partkey = p_partkey", "l_partkey, p_name, l_quantity, p_retailprice") + f""",
g AS (SELECT l_partkey AS product_id, p_name AS product, {_msum('revenue', 'k = 0')} AS revenue,
             sum(l_quantity) FILTER (WHERE k = 0) AS units,
             {_msum('0.5 * l_quantity * p_retailprice', 'k = 0')} AS cost, {_msum('revenue', 'k = 1')} AS prev_revenue
      FROM s GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY revenue DESC, product_id) AS "rank", product_id, product, revenue, units,
       round((revenue - cost) / nullif(revenue, 0) * 100, 2) AS margin_pct, {_pct('revenue', 'prev_revenue')} AS growth_pct
FROM g WHERE revenue IS NOT NULL ORDER BY revenue DESC, product_id LIMIT 10""")
def q_top_products(spark, sf_dir):
    return A.top_products(fx.sales(spark, sf_dir, part=True), period=365, k=10)


@register("funnel", """
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, ts FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
u0 AS (SELECT user_id, day, min(ts) AS m0 FROM e WHERE event_type = 'view' GROUP BY 1, 2),
u1 AS (SELECT user_id, day, min(ts) AS m1 FROM e JOIN u0 USING (user_id, day) WHERE event_type = 'click' AND ts > m0 GROUP BY 1, 2),
u2 AS (SELECT user_id, day, min(ts) AS m2 FROM e JOIN u1 USING (user_id, day) WHERE event_type = 'signup' AND ts > m1 GROUP BY 1, 2),
u3 AS (SELECT user_id, day, min(ts) AS m3 FROM e JOIN u2 USING (user_id, day) WHERE event_type = 'purchase' AND ts > m2 GROUP BY 1, 2),
c AS (SELECT 1 AS stage_order, 'view' AS stage, count(*) AS "count" FROM u0 UNION ALL SELECT 2, 'click', count(*) FROM u1
      UNION ALL SELECT 3, 'signup', count(*) FROM u2 UNION ALL SELECT 4, 'purchase', count(*) FROM u3)
SELECT stage_order, stage, "count",
       round("count" * 100.0::DOUBLE / nullif(lag("count") OVER (ORDER BY stage_order), 0), 1) AS conv_from_prev FROM c""")
def q_funnel(spark, sf_dir):
    return A.funnel(table(spark, sf_dir, "events"))


@register("regions", _two(365, "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
                               "JOIN region ON n_regionkey = r_regionkey", "r_name, o_custkey") + f""",
g AS (SELECT r_name AS region, {_msum('revenue', 'k = 0')} AS revenue,
             count(DISTINCT CASE WHEN k = 0 THEN o_custkey END) AS customers, {_msum('revenue', 'k = 1')} AS prev_revenue
      FROM s GROUP BY 1)
SELECT region, revenue, customers, {_pct('revenue', 'prev_revenue')} AS growth_pct FROM g""")
def q_regions(spark, sf_dir):
    return A.regions(fx.sales(spark, sf_dir, geo=True), period=365)


ROLLUP_SQL = f"""
SELECT date_trunc('day', o_orderdate) AS day, r_name AS region, p_brand AS brand,
       CAST(grouping(date_trunc('day', o_orderdate), r_name, p_brand) AS INTEGER) AS level,
       {_msum(REV)} AS revenue, sum(l_quantity) AS quantity, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (date_trunc('day', o_orderdate), r_name, p_brand)"""


@register("etl_sales_aggregation", ROLLUP_SQL)
def q_etl_sales_aggregation(spark, sf_dir):
    from pyspark.sql import functions as F
    df = A.etl_sales_aggregation(fx.sales(spark, sf_dir, part=True, geo=True))
    return df.withColumn("level", F.col("level").cast("int"))


@register("etl_sales_rollup_written", f"""
SELECT date_trunc('day', o_orderdate) AS day, r_name AS region, p_brand AS brand, {_msum(REV)} AS revenue, sum(l_quantity) AS quantity, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL""")
def q_etl_sales_rollup_written(spark, sf_dir):
    """The rollup's detail level written by month of the order date and read back."""
    from pyspark.sql import functions as F
    from tessera.session import scratch_dir
    path = A.write_sales_rollup(A.etl_sales_aggregation(fx.sales(spark, sf_dir, part=True, geo=True)), scratch_dir(spark, "rollup"))
    return spark.read.parquet(path).select(F.col("day").cast("timestamp_ntz").alias("day"), "region", "brand", "revenue", "quantity", "lines")


@register("etl_sales_incremental", ROLLUP_SQL)
def q_etl_sales_incremental(spark, sf_dir):
    """Three nights: the orders until 60 and 30 days before the last one with their lines, then the rest with urgent
    orders of the second night that come late; each night computes only the days its files touch."""
    import datetime as dt

    from pyspark.sql import functions as F
    from tessera.operators import sales_days as SD
    from tessera.session import scratch_dir
    base, orders, lines = scratch_dir(spark, "sales"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    end = orders.agg(F.max("o_orderdate")).first()[0]     # one scalar
    cuts = [end - dt.timedelta(days=60), end - dt.timedelta(days=30)]

    first, second = (F.coalesce(F.col("o_orderdate") < F.lit(c).cast("timestamp_ntz"), F.lit(False)) for c in cuts)
    night = F.when(first, 0).when(second & (F.col("o_orderpriority") != "1-URGENT"), 1).otherwise(2)
    of = orders.select("o_orderkey", night.alias("_night"))
    # the lines' nights are looked up once, not once a night
    lines = lines.join(of, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey").withColumn("_night", F.coalesce("_night", F.lit(0)))
    lines.write.partitionBy("_night").parquet(f"{base}/delivered")
    lines = spark.read.schema(lines.schema).parquet(f"{base}/delivered")

    def sales_of(found):
        return fx.sales(spark, sf_dir, part=True, geo=True, source=lambda t: {
            "orders": found, "lineitem": spark.read.parquet(f"{base}/lineitem")}.get(t) or table(spark, sf_dir, t))

    for k in range(3):
        orders.filter(night == k).write.mode("append").parquet(f"{base}/orders")
        lines.filter(F.col("_night") == k).drop("_night").write.mode("append").parquet(f"{base}/lineitem")
        SD.refresh_sales_days(spark, f"{base}/orders", f"{base}/lineitem", sales_of, f"{base}/days")
    return SD.sales_totals(spark, f"{base}/days").withColumn("level", F.col("level").cast("int"))


@register("customer_rfm", """
SELECT o_custkey AS c_custkey,
       CAST(date_diff('day', CAST(max(o_orderdate) AS DATE), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) AS INTEGER) AS recency_days,
       count(*) AS frequency, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4))), 2) AS DOUBLE) AS monetary
FROM orders GROUP BY 1""")
def q_customer_rfm(spark, sf_dir):
    return A.customer_rfm(table(spark, sf_dir, "orders"))


@register("customer_segmentation")
def q_customer_segmentation(spark, sf_dir):
    return A.customer_segmentation(A.customer_rfm(table(spark, sf_dir, "orders")), k=4, seed=42)
