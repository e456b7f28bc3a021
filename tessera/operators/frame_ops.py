"""Projections, filters, paging and small row-level transforms."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import ntz_lit


# Fixed value: the largest page the reference's preview accepts.
MAX_PAGE = 500


def _page_size(limit: int, max_limit: int | None) -> int:
    if limit < 1 or (max_limit is not None and limit > max_limit):
        raise ValueError(f"limit must be between 1 and {max_limit}" if max_limit else "limit must be at least 1")
    return int(limit)


def preview_page(df: DataFrame, order_by: list[str], page: int = 1, limit: int = 50,
                 max_limit: int | None = MAX_PAGE) -> DataFrame:
    """Rows of page ``page`` (1-based) of size ``limit`` in key order.

    A page below 1 or a limit outside 1..``max_limit`` raises. Planned as a
    distributed top-(page*limit) followed by an offset; for deep pages prefer
    ``keyset_page`` which does not sort the skipped rows."""
    if page < 1:
        raise ValueError("page must be at least 1")
    n = _page_size(limit, max_limit)
    return df.orderBy(*order_by).offset((page - 1) * n).limit(n)


def preview(df: DataFrame, order_by: list[str], page: int = 1, limit: int = 50, max_limit: int | None = MAX_PAGE) -> DataFrame:
    """One row: headers (column names), total (rows of the whole table), page, limit and the page's rows as JSON text.

    The page is at most ``max_limit`` rows, so it fits one row; the total is one count."""
    rows = preview_page(df, order_by, page, limit, max_limit)
    text = rows.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("r"),
                       F.struct(*[F.col(c) for c in order_by]).alias("o"))
    page_df = text.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    # two one-row tables as one row
    both = page_df.withColumn("total", F.lit(None).cast("bigint")).unionByName(total, allowMissingColumns=True).agg(
        F.first("rows", ignorenulls=True).alias("rows"), F.max("total").alias("total"))
    return both.select(F.array(*[F.lit(c) for c in df.columns]).alias("headers"), "total",
                       F.lit(int(page)).alias("page"), F.lit(int(limit)).alias("limit"), "rows")


def keyset_page(df: DataFrame, key: str, after=None, limit: int = 50, max_limit: int | None = MAX_PAGE) -> DataFrame:
    """Next ``limit`` rows with key > ``after``: a pushed-down filter plus a top-k."""
    n = _page_size(limit, max_limit)
    out = df if after is None else df.filter(F.col(key) > F.lit(after))
    return out.orderBy(key).limit(n)


def plain_text(df: DataFrame, c: str):
    """A cell as text; doubles without an exponent (12345678.9, not 1.23456789E7)."""
    t = df.schema[c].dataType
    if isinstance(t, (T.FloatType, T.DoubleType)):
        x = F.col(c).cast("double")
        whole = F.format_string("%.0f", x)
        # the shortest decimal text: a decimal of the value, trailing zeros cut
        digits = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,12)").cast("string"), "0+$", ""), "\\.$", ".0")
        return F.when(F.abs(x) < 1e25, digits).when(F.isnan(x), F.lit("NaN")).otherwise(whole)
    return F.col(c).cast("string")


def row_search(df: DataFrame, term: str) -> DataFrame:
    """Rows where any cell, as text, contains ``term`` (case-insensitive).

    Null cells never match (the text "null" is not a value)."""
    t = term.lower()
    conds = [F.coalesce(F.lower(plain_text(df, c)).contains(t), F.lit(False)) for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, conds))


def audit_filter(log: DataFrame, ts_col: str, action_col: str, days: int | None = 7, token: str = "all",
                 as_of=None) -> DataFrame:
    """Rows of the last ``days`` days (7/30/90, None = all) up to ``as_of``
    (default: newest row) whose action contains ``token`` ('all' = any)."""
    out = log
    if days:
        if as_of is None:
            as_of = log.agg(F.max(ts_col)).first()[0]
        if as_of is None:                      # empty log
            return out.limit(0)
        out = out.filter(F.col(ts_col) >= ntz_lit(as_of - dt.timedelta(days=int(days))))
    if token and token != "all":
        out = out.filter(F.col(action_col).contains(token))
    return out


def text_filter(df: DataFrame, cols: list[str], term: str) -> DataFrame:
    """Rows where any of ``cols`` contains ``term``, case-insensitive."""
    t = term.lower()
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
                                                 for c in cols]))


def severity_normalize(df: DataFrame, severity: str = "severity", message: str = "message",
                       description: str = "description", title: str = "title") -> DataFrame:
    """level: error -> critical, warning -> warning, anything else -> info;
    text = message, else description, else title."""
    lvl = F.when(F.col(severity) == "error", "critical").when(F.col(severity) == "warning", "warning") \
        .otherwise("info")
    return df.withColumn("level", lvl).withColumn("text", F.coalesce(message, description, title))


# A number as text: Java would also take a type letter (1d, 2f).
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def numeric_coerce(df: DataFrame, c: str) -> DataFrame:
    """Adds ``as_number``: the text as a double where it parses ('' -> 0.0),
    else null; ``as_text`` keeps the text where it does not parse."""
    trimmed = F.trim(F.col(c))
    num = F.when(trimmed == "", F.lit(0.0)).when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    return df.withColumn("as_number", num).withColumn("as_text", F.when(num.isNull(), F.col(c)))


def series_zip(df: DataFrame, key: str, ts_col: str, value_cols: list[str]) -> DataFrame:
    """Parallel arrays -> one row per index; a shorter array is padded with 0.

    Row count per key is the length of the longest array (bounded by the
    series length)."""
    z = df.select(key, F.posexplode(F.arrays_zip(ts_col, *value_cols)).alias("idx", "z"))
    return z.select(key, "idx", F.col(f"z.{ts_col}").alias(ts_col),
                    *[F.coalesce(F.col(f"z.{v}").cast("double"), F.lit(0.0)).alias(v) for v in value_cols])


def last_n_per_key(df: DataFrame, key: str, order_cols: list, n: int = 8) -> DataFrame:
    """Newest ``n`` rows per key (row_number <= n).

    Catalyst plans a partial WindowGroupLimit before the shuffle, so each task
    ships at most n rows per key: a key holding a third of the rows does not
    land in one task whole."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn("rn", F.row_number().over(w).cast("bigint")).filter(F.col("rn") <= n)
