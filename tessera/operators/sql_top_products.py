"""The one SQL text of the reference: top products by revenue in the last N days.

Run through ``spark.sql`` over a ``sales_transactions`` temp view so Catalyst
plans it exactly as it plans the DataFrame form: the date filter is pushed into
the orders scan, the aggregation is partial before the shuffle and
``ORDER BY ... LIMIT`` becomes a distributed TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOP_PRODUCTS_SQL = """
SELECT product_id, product_name,
       CAST(round(sum(CAST(revenue AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_revenue,
       count(order_id) AS order_count
FROM {view}
WHERE transaction_date >= {as_of} - INTERVAL {days} DAYS
GROUP BY product_id, product_name
ORDER BY total_revenue DESC, product_id
LIMIT {k}
"""


def nl_sql_top_products(spark: SparkSession, sales_transactions: DataFrame, days: int = 30,
                        k: int = 10, view: str = "sales_transactions", as_of=None) -> DataFrame:
    """Top ``k`` products by revenue over the ``days`` up to ``as_of``.

    ``as_of`` defaults to the newest transaction date of the view (a scalar
    subquery over it, never the wall clock). Passing it as a value (e.g. the
    newest order date, answered from Parquet footers) turns the predicate into
    a literal that is pushed into the orders scan and avoids evaluating the
    view twice."""
    sales_transactions.createOrReplaceTempView(view)
    if as_of is None:
        as_of_sql = f"(SELECT max(transaction_date) FROM {view})"
    else:
        as_of_sql = f"TIMESTAMP_NTZ '{as_of.isoformat(sep=' ')}'"
    return spark.sql(TOP_PRODUCTS_SQL.format(view=view, days=int(days), k=int(k), as_of=as_of_sql))
