"""Profiling queries (lineitem, orders and the derived events_nulls / events_dups)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans import fixtures as fx
from tessera.plans.registry import register
from tessera.sources.files import table

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
EVENTS_NULLS_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props", "c"]
EVENTS_NULLS_NUM = ["event_id", "user_id", "value", "c"]
EVENTS_NULLS_FLOAT = {"value", "c"}
EVENTS_NULLS_STR = ["event_type", "props"]

DUCK_PANDAS = ("CASE {t} WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int32' WHEN 'SMALLINT' THEN 'int16' "
               "WHEN 'TINYINT' THEN 'int8' WHEN 'DOUBLE' THEN 'float64' WHEN 'FLOAT' THEN 'float32' "
               "WHEN 'BOOLEAN' THEN 'bool' WHEN 'TIMESTAMP' THEN 'datetime64[ns]' ELSE 'object' END")
DUCK_SPARK = ("CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint' "
              "WHEN 'TINYINT' THEN 'tinyint' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' "
              "WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR' THEN 'string' "
              "WHEN 'DATE' THEN 'date' ELSE lower({t}) END")


def _with(name: str, sql: str) -> str:
    return f"WITH {name} AS ({sql})\n"


# -- schema --------------------------------------------------------------------
@register("profile_schema", f"""
SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
       {DUCK_PANDAS.format(t='data_type')} AS dtype, {DUCK_SPARK.format(t='data_type')} AS spark_type
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def q_profile_schema(spark, sf_dir):
    return P.profile_schema(table(spark, sf_dir, "lineitem"))


# -- numeric describe ----------------------------------------------------------
def _numeric_sql(src: str, cols: list[str], floats=()) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        if c in floats:
            v = f"CASE WHEN isnan({c}) THEN NULL ELSE CAST({c} AS DOUBLE) END"
        parts.append(
            f"SELECT '{c}' AS column_name, count({v}) AS \"count\", round(avg({v}), 4) AS mean, "
            f"round(stddev_samp({v}), 4) AS std, min({v}) AS \"min\", round(quantile_cont({v}, 0.25), 4) AS p25, "
            f"round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75, "
            f"max({v}) AS \"max\" FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("profile_numeric_stats", _numeric_sql("lineitem", LINEITEM_NUM, {"l_quantity", "l_extendedprice",
                                                                             "l_discount", "l_tax"}))
def q_profile_numeric_stats(spark, sf_dir):
    return P.profile_numeric_stats(table(spark, sf_dir, "lineitem"))


# -- categorical describe ------------------------------------------------------
def _categorical_sql(src: str, cols: list[str]) -> str:
    vc = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {src} GROUP BY 2"
        for c in cols)
    return f"""
WITH vc AS ({vc}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rk
           FROM vc WHERE value IS NOT NULL)
SELECT a.column_name, a."count", a."unique", r.value AS top, r.n AS freq
FROM (SELECT column_name, CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS "count",
             count(*) FILTER (WHERE value IS NOT NULL) AS "unique" FROM vc GROUP BY 1) a
LEFT JOIN ranked r ON r.column_name = a.column_name AND r.rk = 1"""


@register("profile_categorical_stats", _categorical_sql("orders", ["o_orderstatus", "o_orderpriority"]))
def q_profile_categorical_stats(spark, sf_dir):
    return P.profile_categorical_stats(table(spark, sf_dir, "orders"))


@register("profile_categorical_nulls", _with("en", fx.EVENTS_NULLS_SQL) + _categorical_sql("en", EVENTS_NULLS_STR).replace("WITH vc", ", vc", 1))
def q_profile_categorical_nulls(spark, sf_dir):
    return P.profile_categorical_stats(fx.events_nulls(spark, sf_dir))


# -- missing -------------------------------------------------------------------
def _missing_sql(src: str, cols: list[str], floats=()) -> str:
    parts = []
    for c in cols:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in floats else "")
        parts.append(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {cond}) AS missing, "
                     f"round(count(*) FILTER (WHERE {cond}) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("profile_missing", _with("en", fx.EVENTS_NULLS_SQL) + _missing_sql("en", EVENTS_NULLS_COLS, EVENTS_NULLS_FLOAT))
def q_profile_missing(spark, sf_dir):
    return P.profile_missing(fx.events_nulls(spark, sf_dir))


# -- duplicates ----------------------------------------------------------------
@register("profile_duplicates", _with("ed", fx.EVENTS_DUPS_SQL) + """
SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS n FROM ed GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY user_id, event_type, value"))
def q_profile_duplicates(spark, sf_dir):
    return P.profile_duplicates(fx.events_dups(spark, sf_dir))


# -- unique --------------------------------------------------------------------
def _unique_sql(src: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + CAST(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
        f"AS unique_values FROM {src}" for c in cols)


@register("profile_unique", _with("en", fx.EVENTS_NULLS_SQL) + _unique_sql("en", EVENTS_NULLS_COLS))
def q_profile_unique(spark, sf_dir):
    return P.profile_unique(fx.events_nulls(spark, sf_dir))


# -- correlations --------------------------------------------------------------
def _corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            r = (f"covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) FILTER (WHERE {both}) / "
                 f"nullif(stddev_samp(CAST({a} AS DOUBLE)) FILTER (WHERE {both}) * "
                 f"stddev_samp(CAST({b} AS DOUBLE)) FILTER (WHERE {both}), 0)")
            parts.append(f"SELECT {i} AS i, {j} AS j, '{a}' AS col_a, '{b}' AS col_b, "
                         f"round(coalesce({r}, 0.0), 4) AS corr FROM {src}")
    return "\nUNION ALL\n".join(parts)


@register("profile_correlations", _with("en", fx.EVENTS_NULLS_SQL) + _corr_sql("en", EVENTS_NULLS_NUM))
def q_profile_correlations(spark, sf_dir):
    return P.profile_correlations(fx.events_nulls(spark, sf_dir))


@register("correlation_long", _corr_sql("lineitem", LINEITEM_NUM))
def q_correlation_long(spark, sf_dir):
    return P.profile_correlations(table(spark, sf_dir, "lineitem"))


# -- outliers ------------------------------------------------------------------
def _outlier_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, round(q1, 4) AS q1, round(q3, 4) AS q3,
  (SELECT count(*) FROM {src} WHERE q3 - q1 <> 0 AND ({v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1))) AS outliers
FROM (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {src})""")
    return "\nUNION ALL\n".join(parts)


@register("profile_outliers", _with("en", fx.EVENTS_NULLS_SQL) + _outlier_sql("en", EVENTS_NULLS_NUM))
def q_profile_outliers(spark, sf_dir):
    return P.profile_outliers(fx.events_nulls(spark, sf_dir))


# -- class imbalance -----------------------------------------------------------
def _imbalance_sql(src: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, coalesce(round(max(n) / sum(n), 4), 0.0) AS imbalance "
        f"FROM (SELECT {c}, count(*) AS n FROM {src} GROUP BY 1)" for c in cols)


@register("profile_class_imbalance", _with("en", fx.EVENTS_NULLS_SQL) + _imbalance_sql("en", EVENTS_NULLS_STR))
def q_profile_class_imbalance(spark, sf_dir):
    return P.profile_class_imbalance(fx.events_nulls(spark, sf_dir))


# -- histogram -----------------------------------------------------------------
def _hist_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"CASE WHEN CAST({c} AS DOUBLE) IN ('inf'::DOUBLE, '-inf'::DOUBLE) THEN NULL ELSE CAST({c} AS DOUBLE) END"
        parts.append(f"""SELECT '{c}' AS column_name, g.k AS bin, round(b.lo + g.k * ((b.hi - b.lo) / 10), 4) AS lower,
  round(b.lo + (g.k + 1) * ((b.hi - b.lo) / 10), 4) AS upper,
  (SELECT count(*) FROM {src} WHERE {v} IS NOT NULL AND
     CAST(least(floor(({v} - b.lo) / (b.hi - b.lo) * 10), 9) AS INTEGER) = g.k) AS "count"
FROM (SELECT CASE WHEN mn IS NULL THEN 0.0 WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn IS NULL THEN 1.0 WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
      FROM (SELECT min({v}) AS mn, max({v}) AS mx FROM {src})) b,
     (SELECT CAST(range AS INTEGER) AS k FROM range(10)) g""")
    return "\nUNION ALL\n".join(parts)


@register("profile_histogram", _with("en", fx.EVENTS_NULLS_SQL) + _hist_sql("en", EVENTS_NULLS_NUM))
def q_profile_histogram(spark, sf_dir):
    return P.profile_histogram(fx.events_nulls(spark, sf_dir))


# -- column table --------------------------------------------------------------
def _column_stats_sql() -> str:
    schema = "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS column_name, {DUCK_PANDAS.format(t=f'typeof(any_value({c}))')} AS dtype FROM en"
        for i, c in enumerate(EVENTS_NULLS_COLS))
    num = _numeric_sql("en", EVENTS_NULLS_NUM, EVENTS_NULLS_FLOAT)
    return (f"WITH en AS ({fx.EVENTS_NULLS_SQL}),\nsch AS ({schema}),\nmis AS ({_missing_sql('en', EVENTS_NULLS_COLS, EVENTS_NULLS_FLOAT)}),\n"
            f"uni AS ({_unique_sql('en', EVENTS_NULLS_COLS)}),\nnum AS ({num}),\nout AS ({_outlier_sql('en', EVENTS_NULLS_NUM)})\n"
            "SELECT sch.position, sch.column_name, sch.dtype, mis.missing, mis.missing_pct, uni.unique_values, "
            "num.\"count\", num.mean, num.std, num.\"min\", num.\"max\", out.outliers FROM sch "
            "LEFT JOIN mis USING (column_name) LEFT JOIN uni USING (column_name) LEFT JOIN num USING (column_name) "
            "LEFT JOIN out USING (column_name)")


@register("column_stats_sorted", _column_stats_sql())
def q_column_stats_sorted(spark, sf_dir):
    return P.column_stats_sorted(fx.events_nulls(spark, sf_dir), sort_by="missing")


# -- PCA and the whole profile (rows-only; numpy twin in tests) ----------------
@register("profile_pca")
def q_profile_pca(spark, sf_dir):
    coords, _ = P.profile_pca(table(spark, sf_dir, "lineitem"), LINEITEM_NUM, k=2,
                              id_cols=["l_orderkey", "l_linenumber"])
    return coords


@register("profile_pca_variance")
def q_profile_pca_variance(spark, sf_dir):
    _, ratio = P.profile_pca(table(spark, sf_dir, "lineitem"), LINEITEM_NUM, k=2)
    return ratio


@register("profile_pca_two", """
SELECT i AS component, round((1 + CASE WHEN i = 1 THEN abs(r) ELSE -abs(r) END) / 2, 6) AS explained_variance_ratio
FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), unnest([1, 2]) AS t(i)""")
def q_profile_pca_two(spark, sf_dir):
    """Two standardised columns have the closed form (1 +- |r|) / 2."""
    _, ratio = P.profile_pca(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], k=2)
    return ratio.select("component", F.round("explained_variance_ratio", 6).alias("explained_variance_ratio"))


@register("profile_dataset")
def q_profile_dataset(spark, sf_dir):
    return P.profile_dataset(table(spark, sf_dir, "orders"))


# -- profile by parts ------------------------------------------------------------
def _merged(spark, sf_dir):
    """lineitem profiled in three parts by ship year, each from its own scan."""
    from tessera.operators import profile_parts as PP
    from tessera.session import scratch_dir
    li, path = table(spark, sf_dir, "lineitem"), scratch_dir(spark, "profile")
    year = F.coalesce(F.year("l_shipdate"), F.lit(0))
    for part, rows in (("old", year < 1995), ("middle", year.between(1995, 1997)), ("new", year > 1997)):
        PP.refresh_profile(li.filter(rows), path, part)
    return PP.merged_profile(spark, path)


@register("profile_parts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(3 AS BIGINT) AS parts, count(*) AS rows, count({c}) AS count, count(*) - count({c}) AS missing, "
    f"round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, "
    f"CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in LINEITEM_NUM))
def q_profile_parts(spark, sf_dir):
    return _merged(spark, sf_dir).filter(F.col("column_name").isin(LINEITEM_NUM)).select(
        "column_name", "parts", "rows", "count", "missing", "mean", "std", "min", "max")


@register("profile_parts_sketches")
def q_profile_parts_sketches(spark, sf_dir):
    """Quartiles, distinct counts and frequent values of every column, within the sketches' bounds."""
    return _merged(spark, sf_dir).select("column_name", "p25", "p50", "p75", "distinct", F.to_json("top").alias("top"))
