"""Table profiling in long form: one row per (column, statistic group).

Design notes for scale:
* Statistics that are algebraic (count, sum, min, max, moments, covariance)
  are computed for all columns in ONE aggregate: partial aggregation runs
  map-side, only one small buffer per task is shuffled.
* Per-value statistics (distinct counts, top value, class shares, histogram
  bins) stack the columns into (column_name, value) pairs and aggregate by
  that pair. The partial aggregate right after the stack collapses each task
  to its distinct pairs before the shuffle, so a value held by a third of all
  rows costs one row per task, not a third of the data in one task. This also
  avoids the ``Expand`` blow-up of many ``count(DISTINCT)`` in one aggregate.
* Exact quartiles come from ``grouped_quantiles`` over the stacked columns:
  distinct-value counts, range partitioning and running counts, so no task
  holds a whole column (``percentile`` would merge a value map per column in
  one task). ``approx=True`` switches to ``percentile_approx`` sketches.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import is_missing, numeric_columns, spread
from tessera.operators.quantiles import quantile_arrays

QUARTILES = [0.25, 0.5, 0.75]


def _dtype(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _num(df: DataFrame, c: str) -> F.Column:
    """Numeric column as double with NaN mapped to null (pandas' missing)."""
    v = F.col(c).cast("double")
    if isinstance(_dtype(df, c), (T.FloatType, T.DoubleType)):
        v = F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(v)
    return v


def _stack(pairs: list[F.Column]) -> F.Column:
    return F.inline(F.array(*pairs))


def _method(approx: bool, method: str | None) -> str:
    return method or ("sketch" if approx else "distributed")


def _column_quantiles(df: DataFrame, cols: list[str], qs, method: str) -> DataFrame:
    """(column_name, quantiles array) for every numeric column in one job."""
    stacked = df.select(_stack([F.struct(F.lit(c).alias("column_name"), _num(df, c).alias("v")) for c in cols]))
    return quantile_arrays(stacked, "v", qs, ["column_name"], method)


# The dtype names pandas reports for each Spark type.
PANDAS_DTYPES = [
    (T.BooleanType, "bool"), (T.ByteType, "int8"), (T.ShortType, "int16"),
    (T.IntegerType, "int32"), (T.LongType, "int64"), (T.FloatType, "float32"),
    (T.DoubleType, "float64"), (T.TimestampType, "datetime64[ns]"),
    (T.TimestampNTZType, "datetime64[ns]"),
]


def pandas_dtype(dt: T.DataType) -> str:
    for cls, name in PANDAS_DTYPES:
        if isinstance(dt, cls):
            return name
    return "object"


def profile_schema(df: DataFrame) -> DataFrame:
    """(position, column_name, dtype, spark_type); schema only, no job."""
    spark = df.sparkSession
    rows = [(i, f.name, pandas_dtype(f.dataType), f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields)]
    schema = "position int, column_name string, dtype string, spark_type string"
    return spark.createDataFrame(rows, schema)


def profile_numeric_stats(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                          method: str | None = None) -> DataFrame:
    """count (non-null), mean, std (ddof 1), min, 25/50/75 % (linear), max.

    Moments come from one aggregate; quartiles from ``grouped_quantiles``
    over the stacked columns (exact, bounded per-task memory), or a sketch
    with ``approx=True``."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count bigint, mean double, std double, min double, "
                "p25 double, p50 double, p75 double, max double")
    aggs = []
    for i, c in enumerate(cols):
        v = _num(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    moments = wide.select(_stack([
        F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"),
                 F.round(f"m{i}", 4).alias("mean"), F.round(f"s{i}", 4).alias("std"),
                 F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)]))
    q = _column_quantiles(df, cols, QUARTILES, _method(approx, method))
    # both sides have one row per column
    j = moments.join(q, "column_name", "left")
    return j.select("column_name", "count", "mean", "std", "min",
                    F.round(F.col("quantiles")[0], 4).alias("p25"), F.round(F.col("quantiles")[1], 4).alias("p50"),
                    F.round(F.col("quantiles")[2], 4).alias("p75"), "max")


def categorical_columns(df: DataFrame, include_bool: bool = True) -> list[str]:
    kinds = (T.StringType, T.BooleanType) if include_bool else (T.StringType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n) for every column; null is its own value."""
    pairs = df.select(_stack([
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]))
    return pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_categorical_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """String and bool columns: count (non-null), unique (non-null), top, freq.

    Ties for the top value go to the smallest value (pandas takes the first
    one seen, which depends on file order)."""
    cols = cols if cols is not None else categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, count bigint, unique bigint, top string, freq bigint")
    vc = _value_counts(df, cols)
    nn = F.col("value").isNotNull()
    best = F.min(F.when(nn, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))))
    out = vc.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(nn, F.col("n"))), F.lit(0)).cast("bigint").alias("count"),
        F.count(F.when(nn, F.lit(1))).alias("unique"),
        best.alias("best"))
    return out.select("column_name", "count", "unique", F.col("best.v").alias("top"),
                      (-F.col("best.neg")).alias("freq"))


def profile_missing(df: DataFrame) -> DataFrame:
    """(column_name, missing, missing_pct): nulls, and NaN in float columns."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.sum(is_missing(f.name, f.dataType).cast("long")).alias(f"m{i}") for i, f in enumerate(fields)]
    wide = df.agg(*aggs)
    return wide.select(_stack([
        F.struct(F.lit(f.name).alias("column_name"),
                 F.coalesce(F.col(f"m{i}"), F.lit(0)).cast("bigint").alias("missing"),
                 F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("_rows")), 2).alias("missing_pct"))
        for i, f in enumerate(fields)]))


def profile_duplicates(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicates): rows repeating an earlier row; null = null."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def profile_unique(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column_name, unique_values): distinct values, null counted as a value."""
    cols = cols if cols is not None else df.columns
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, unique_values bigint")
    if approx:
        def v(c):
            return _num(df, c) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)
        wide = df.agg(*[(F.approx_count_distinct(v(c)) + F.max(v(c).isNull().cast("int"))).alias(f"u{i}")
                        for i, c in enumerate(cols)])
        return wide.select(_stack([F.struct(F.lit(c).alias("column_name"), F.col(f"u{i}").cast("bigint")
                                            .alias("unique_values")) for i, c in enumerate(cols)]))
    # stack by type family so values are compared natively, not as text:
    # integers as bigint, fractions as double (grouping equates -0.0 / 0.0 and
    # NaNs, as pandas does), everything else as its string form
    fam = {"i": [], "f": [], "s": []}
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            fam["i"].append(c)
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            fam["f"].append(c)
        else:
            fam["s"].append(c)
    casts = {"i": "bigint", "f": "double", "s": "string"}
    out = None
    for k, members in fam.items():
        if not members:
            continue
        def val(c, k=k):
            v = F.col(c).cast(casts[k])
            return F.when(F.isnan(v), F.lit(None)).otherwise(v) if k == "f" else v   # NaN is missing, like null
        pairs = df.select(_stack([F.struct(F.lit(c).alias("column_name"), val(c).alias("value")) for c in members]))
        u = pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")) \
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values"))
        out = u if out is None else out.unionByName(u)
    return out


def _pair_corr(a: F.Column, b: F.Column) -> F.Column:
    both = a.isNotNull() & b.isNotNull()
    am, bm = F.when(both, a), F.when(both, b)
    r = F.try_divide(F.covar_samp(am, bm), F.stddev_samp(am) * F.stddev_samp(bm))
    return F.coalesce(r, F.lit(0.0))


def profile_correlations(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix in long form (i, j, col_a, col_b, corr), pairwise-complete.

    Undefined correlations (constant column, < 2 complete pairs) are 0.0, also
    on the diagonal. Never ``corr`` (it raises on constant columns under ANSI).
    Pass 1 takes null counts and means per column. Pairs of null-free columns
    then need only sums of centred products (two-pass formula: one sum per
    pair, stable and codegen-friendly); pairs touching a nullable column use
    covariance / std masked to their complete rows."""
    cols = cols if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "i int, j int, col_a string, col_b string, corr double")
    x = spread(df.select(*[_num(df, c).alias(f"_c{i}") for i, c in enumerate(cols)]))
    # pass 1: nulls and means per column (2k numbers, collected)
    first = x.agg(*[F.count(F.when(F.col(f"_c{i}").isNull(), 1)).alias(f"z{i}") for i in range(len(cols))],
                  *[F.avg(F.col(f"_c{i}")).alias(f"m{i}") for i in range(len(cols))]).first()
    clean = [first[f"z{i}"] == 0 and first[f"m{i}"] is not None for i in range(len(cols))]
    v = [F.col(f"_c{i}") for i in range(len(cols))]
    d = [v[i] - F.lit(first[f"m{i}"]) if clean[i] else None for i in range(len(cols))]
    # pass 2: centred sums for null-free pairs (one sum each), masked
    # covariance form for pairs touching a nullable column
    aggs = [F.sum(d[i] * d[i]).alias(f"ss{i}") for i in range(len(cols)) if clean[i]]
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            if clean[i] and clean[j]:
                aggs.append(F.sum(d[i] * d[j]).alias(f"sp{i}_{j}"))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            if not (clean[i] and clean[j]):
                aggs.append(F.round(_pair_corr(v[i], v[j]), 4).alias(f"r{i}_{j}"))
    wide = x.agg(*aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = min(i, j), max(i, j)
            if clean[lo] and clean[hi]:
                if lo == hi:
                    r = F.when(F.col(f"ss{lo}") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
                else:
                    r = F.round(F.coalesce(F.try_divide(F.col(f"sp{lo}_{hi}"),
                                                        F.sqrt(F.col(f"ss{lo}") * F.col(f"ss{hi}"))), F.lit(0.0)), 4)
            else:
                r = F.col(f"r{lo}_{hi}")
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(a).alias("col_a"),
                                  F.lit(b).alias("col_b"), r.alias("corr")))
    return wide.select(_stack(cells))


def profile_outliers(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                     method: str | None = None) -> DataFrame:
    """(column_name, q1, q3, outliers): Tukey fences, strict; iqr == 0 -> 0."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, q1 double, q3 double, outliers bigint")
    vals = {c: _num(df, c) for c in cols}
    # pass 1: quartiles (two numbers per column, collected)
    got = {r["column_name"]: r["quantiles"] for r in _column_quantiles(df, cols, [0.25, 0.75], _method(approx, method)).collect()}
    quart = {f"q{i}": got.get(c) for i, c in enumerate(cols)}
    # pass 2: fence counts with the quartiles as literals
    aggs = []
    for i, c in enumerate(cols):
        q = quart[f"q{i}"]
        if q is None or q[0] is None or q[1] == q[0]:
            aggs.append(F.lit(0).cast("bigint").alias(f"o{i}"))
            continue
        iqr = q[1] - q[0]
        out = (vals[c] < F.lit(q[0] - 1.5 * iqr)) | (vals[c] > F.lit(q[1] + 1.5 * iqr))
        aggs.append(F.count(F.when(out, 1)).alias(f"o{i}"))
    counts = df.agg(*aggs)

    def qlit(i, k):
        q = quart[f"q{i}"]
        return F.round(F.lit(None if q is None else q[k]).cast("double"), 4)
    return counts.select(_stack([
        F.struct(F.lit(c).alias("column_name"), qlit(i, 0).alias("q1"), qlit(i, 1).alias("q3"),
                 F.col(f"o{i}").cast("bigint").alias("outliers"))
        for i, c in enumerate(cols)]))


def profile_class_imbalance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_name, imbalance): share of the most frequent value, null is a value."""
    cols = cols if cols is not None else categorical_columns(df, include_bool=False)
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in cols], "column_name string")
    vc = _value_counts(df, cols)
    share = vc.groupBy("column_name").agg(F.round(F.max("n") / F.sum("n"), 4).alias("imbalance"))
    # The name list is bounded by the schema width.
    return F.broadcast(names).join(share, "column_name", "left").select(
        "column_name", F.coalesce("imbalance", F.lit(0.0)).alias("imbalance"))


HIST_BINS = 10


def profile_histogram(df: DataFrame, cols: list[str] | None = None, bins: int = HIST_BINS) -> DataFrame:
    """(column_name, bin, lower, upper, count): equal-width bins over [min, max].

    bin = floor((v - min) / (max - min) * bins) clamped to bins - 1; when
    min == max the range is [v - 0.5, v + 0.5] and every value lands in the
    middle bin; an all-null column gives zeros over [0, 1]; +-inf is skipped.
    """
    cols = cols if cols is not None else numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, bin int, lower double, upper double, count bigint")

    def finite(c):
        v = _num(df, c)
        return F.when(~v.isin(float("inf"), float("-inf")), v)

    vals = {c: finite(c) for c in cols}
    # pass 1: range of each column (one row, collected as scalars)
    bounds = df.agg(*[F.struct(F.min(vals[c]).alias("mn"), F.max(vals[c]).alias("mx")).alias(f"b{i}")
                      for i, c in enumerate(cols)]).first() if cols else None

    def lo_hi(i):
        mn, mx = bounds[f"b{i}"]["mn"], bounds[f"b{i}"]["mx"]
        if mn is None:
            return F.lit(0.0), F.lit(1.0)
        if mn == mx:
            return F.lit(mn) - 0.5, F.lit(mx) + 0.5
        return F.lit(float(mn)), F.lit(float(mx))

    # pass 2: bin counts with the ranges as literals
    binned = df.select(*[vals[c].alias(f"v{i}") for i, c in enumerate(cols)])
    pairs = []
    for i, c in enumerate(cols):
        lo, hi = lo_hi(i)
        v = F.col(f"v{i}")
        b = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
        pairs.append(F.struct(F.lit(c).alias("column_name"), F.when(v.isNotNull(), b).alias("bin")))
    counts = binned.select(_stack(pairs)).filter(F.col("bin").isNotNull()) \
        .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid_rows = []
    for i, c in enumerate(cols):
        lo, hi = lo_hi(i)
        w = (hi - lo) / bins
        grid_rows.append(F.struct(F.lit(c).alias("column_name"),
                                  F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), _edges(lo, w)).alias("cells")))
    grid = spark.range(1).select(_stack(grid_rows)).select("column_name", F.inline("cells"))
    # grid has len(cols) * bins rows: bounded by schema width and bin count.
    return F.broadcast(grid).join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _edges(lo, w):
    def cell(k):
        return F.struct(k.alias("bin"), F.round(lo + k * w, 4).alias("lower"),
                        F.round(lo + (k + 1) * w, 4).alias("upper"))
    return cell


def column_stats_sorted(df: DataFrame, sort_by: str = "missing", descending: bool = True) -> DataFrame:
    """One row per column joining the profile parts; sorted by ``sort_by``
    with nulls sorted as 0 and the column name as tie-breaker."""
    spark = df.sparkSession
    types = profile_schema(df).select("position", "column_name", "dtype")
    miss = profile_missing(df)
    uniq = profile_unique(df)
    num = profile_numeric_stats(df).select("column_name", "count", "mean", "std", "min", "max")
    outl = profile_outliers(df).select("column_name", "outliers")
    out = types.join(miss, "column_name", "left").join(uniq, "column_name", "left") \
        .join(num, "column_name", "left").join(outl, "column_name", "left")
    key = F.coalesce(F.col(sort_by).cast("double"), F.lit(0.0))
    return out.orderBy(key.desc() if descending else key.asc(), "column_name")


def profile_pca(df: DataFrame, cols: list[str] | None = None, k: int = 2, id_cols: list[str] | None = None):
    """Principal components of the z-scored numeric columns.

    Rows with any null numeric are dropped. Columns are standardised with the
    population std (ddof 0; a constant column keeps scale 1, i.e. stays 0).
    Returns (coordinates DataFrame, explained-variance-ratio DataFrame). The
    sign of each component is fixed so its largest-magnitude loading is
    positive. Fitting is MLlib's distributed covariance plus a p x p
    eigensolve on the driver: fine for up to a few thousand columns.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    import numpy as np

    spark = df.sparkSession
    cols = cols if cols is not None else numeric_columns(df)
    id_cols = id_cols or []
    empty = (spark.createDataFrame([], ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols]
                                                  + [f"pc{j + 1} double" for j in range(k)])),
             spark.createDataFrame([], "component int, explained_variance_ratio double"))
    if len(cols) < 2:
        return empty
    ids = [F.col(c).alias(f"__id{i}") for i, c in enumerate(id_cols)]
    base = df.select(*ids, *[_num(df, c).alias(c) for c in cols]).dropna(subset=cols)
    asm = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="skip")
    x = asm.transform(base)
    n = x.count()
    if n == 0:
        return empty
    kk = min(k, len(cols))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(x)
    z = scaler.transform(x)
    # MLlib scales by the sample std; pandas/sklearn by the population std.
    # Constant columns: MLlib leaves them 0 after centering, as sklearn does.
    pca = PCA(k=kk, inputCol="_z", outputCol="_pc").fit(z)
    pc = pca.pc.toArray()
    signs = [1.0 if pc[int(np.argmax(np.abs(pc[:, j]))), j] >= 0 else -1.0 for j in range(kk)]
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    arr = vector_to_array("_pc")
    coords = pca.transform(z).select(*[F.col(f"__id{i}").alias(c) for i, c in enumerate(id_cols)], *[(arr[j] * (signs[j] * factor)).alias(f"pc{j + 1}") for j in range(kk)])
    ratio = spark.createDataFrame([(j + 1, float(v)) for j, v in enumerate(pca.explainedVariance.toArray())],
                                  "component int, explained_variance_ratio double")
    return coords, ratio


def profile_dataset(df: DataFrame, approx: bool = False) -> DataFrame:
    """All profile parts as one long table (section, column_name, metric, value, text).

    Every part is a pruned scan of its own; nothing is persisted. A caller whose
    input is dear to compute persists it and releases it afterwards."""
    parts = []

    def longify(part: DataFrame, section: str, keys: list[str], metrics: list[str], text: list[str] = ()):
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                          F.lit(None).cast("string").alias("text")) for m in metrics]
        cells += [F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"),
                           F.col(m).cast("string").alias("text")) for m in text]
        name = F.concat_ws(".", *[F.col(k).cast("string") for k in keys]) if keys else F.lit(None).cast("string")
        return part.select(F.lit(section).alias("section"), name.alias("column_name"), F.inline(F.array(*cells)))

    parts.append(longify(profile_schema(df), "schema", ["column_name"], [], ["dtype"]))
    parts.append(longify(profile_numeric_stats(df, approx=approx), "statistics", ["column_name"],
                         ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]))
    cat = categorical_columns(df)
    if cat:
        parts.append(longify(profile_categorical_stats(df, cat), "statistics", ["column_name"],
                             ["count", "unique", "freq"], ["top"]))
    parts.append(longify(profile_missing(df), "missing_values", ["column_name"], ["missing", "missing_pct"]))
    parts.append(longify(profile_duplicates(df), "duplicates", [], ["duplicates"]))
    parts.append(longify(profile_unique(df, approx=approx), "unique_values", ["column_name"], ["unique_values"]))
    if numeric_columns(df):
        parts.append(longify(profile_correlations(df), "correlations", ["col_a", "col_b"], ["corr"]))
        parts.append(longify(profile_outliers(df, approx=approx), "outliers", ["column_name"], ["outliers"]))
        parts.append(longify(profile_histogram(df), "histogram", ["column_name", "bin"], ["count", "lower", "upper"]))
    obj = categorical_columns(df, include_bool=False)
    if obj:
        parts.append(longify(profile_class_imbalance(df, obj), "class_imbalance", ["column_name"], ["imbalance"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

