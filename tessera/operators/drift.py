"""Distribution drift (population stability index) between a baseline and a
current window, per feature.

Bin edges are the baseline deciles of each feature; a value falls in bin
b = number of edges strictly below it (0..9). PSI = sum over bins of
(q - p) * ln(q / p) with shares floored at 1e-6. Everything is a grouped
aggregate keyed by feature; the (feature x bin) grid has 10 rows per feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import ntz_lit
from tessera.operators.quantiles import quantile_arrays

# The drift threshold of the published model records
# (0.062 -> WARNING, 0.012 and 0.004 -> OK).
DRIFT_THRESHOLD = 0.05
BINS = 10
FLOOR = 1e-6


def _edges(n: int = BINS):
    return [round(k / n, 10) for k in range(1, n)]


def feature_psi(df: DataFrame, feature: str, window: str, value: str, baseline: str = "baseline",
                current: str = "current", approx: bool = False, threshold: float = DRIFT_THRESHOLD,
                few: bool = False) -> DataFrame:
    """(feature, psi, status) for rows tagged ``window`` in {baseline, current}.

    Missing values (null, NaN) are left out on both sides; a null feature is a
    feature of its own. The baseline deciles per feature (exact, distributed)
    are equi-joined to the rows; counts per (feature, window, bin) are
    zero-filled from the (feature x bin) grid by a union and folded to PSI by
    one more aggregate. Nothing runs while the plan is built but the range
    sampling of the exact deciles. ``few``: the caller knows the features to be few, so the
    deciles go to the rows; otherwise a feature's rows would meet in one reducer first."""
    qs = _edges()
    v = F.col(value).cast("double")
    tagged = df.filter(F.col(window).isin(baseline, current) & v.isNotNull() & ~F.isnan(v)).select(
        F.col(feature).alias("feature"), F.col(window).alias("w"), v.alias("v"))
    edge_df = quantile_arrays(tagged.filter(F.col("w") == baseline), "v", qs, ["feature"], "sketch" if approx else "distributed") \
        .select(F.col("feature").alias("_f"), F.col("quantiles").alias("edges"))
    # one row per feature: broadcast by AQE where it is small, a shuffle join beyond
    binned = tagged.join(F.broadcast(edge_df) if few else edge_df, F.col("feature").eqNullSafe(F.col("_f"))).select(
        "feature", "w", F.size(F.filter("edges", lambda e: F.col("v") > e)).alias("bin"))
    grid = edge_df.select(F.col("_f").alias("feature"), F.lit(None).cast("string").alias("w"),
                          F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), F.lit(0).cast("bigint").alias("n"))
    counts = binned.groupBy("feature", "w", "bin").agg(F.count(F.lit(1)).alias("n"))
    per = counts.unionByName(grid).groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("w") == baseline, F.col("n")).otherwise(0)).alias("nb"),
        F.sum(F.when(F.col("w") == current, F.col("n")).otherwise(0)).alias("nc"))
    by_feature = Window.partitionBy("feature")   # BINS rows per feature
    p = F.greatest(F.coalesce(F.try_divide(F.col("nb"), F.sum("nb").over(by_feature)), F.lit(0.0)), F.lit(FLOOR))
    q = F.greatest(F.coalesce(F.try_divide(F.col("nc"), F.sum("nc").over(by_feature)), F.lit(0.0)), F.lit(FLOOR))
    g = per.select("feature", p.alias("p"), q.alias("q"))
    psi = g.groupBy("feature").agg(F.round(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))), 4).alias("psi"))
    return psi.withColumn("status", F.when(F.col("psi") > threshold, "WARNING").otherwise("OK"))


def middle(lo, hi):
    """The instant halfway between two dates or timestamps, as a literal."""
    return ntz_lit(lo + (hi - lo) / 2)


def column_psi(df: DataFrame, columns: list[str], window, **params) -> DataFrame:
    """``feature_psi`` of every column, each a feature: the columns are stacked in one pass."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    stacked = df.withColumn("_w", window).select(F.col("_w").alias("window"), cells)
    return feature_psi(stacked, "feature", "window", "value", few=True, **params)


def drift_report(feature_drift: DataFrame, prediction_drift: DataFrame, model_name: str,
                 threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """One row per model: feature_drift_score (max PSI), prediction_drift_score,
    status, drifted_features (sorted array)."""
    # one row per feature on each side (bounded): one aggregate over their union
    both = feature_drift.select(F.lit("f").alias("kind"), "feature", "psi").unionByName(
        prediction_drift.select(F.lit("p").alias("kind"), "feature", "psi"))
    is_f = F.col("kind") == "f"
    r = both.agg(
        F.max(F.when(is_f, F.col("psi"))).alias("feature_drift_score"),
        F.max(F.when(~is_f, F.col("psi"))).alias("prediction_drift_score"),
        F.sort_array(F.collect_list(F.when(is_f & (F.col("psi") > threshold), F.col("feature")))).alias("drifted_features"))
    worst = F.greatest("feature_drift_score", "prediction_drift_score")
    return r.select(F.lit(model_name).alias("model_name"), "feature_drift_score", "prediction_drift_score",
                    F.when(worst > threshold, "WARNING").otherwise("OK").alias("status"), "drifted_features")


def drift_alerts(feature_drift: DataFrame, model_name: str, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """An alert row per drifted feature: "{model}: {feature} drift = {pct}%"."""
    d = feature_drift.filter(F.col("psi") > threshold)
    return d.select(F.lit(model_name).alias("model_name"), "feature", "psi",
                    F.when(F.col("psi") > 0.2, "error").otherwise("warning").alias("severity"),
                    F.format_string("%s: %s drift = %.1f%%", F.lit(model_name), F.col("feature"),
                                    F.round(F.col("psi") * 100, 1)).alias("message"))
