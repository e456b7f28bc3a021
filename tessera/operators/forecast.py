"""Per-series forecasting as grouped aggregation (no per-series Python).

Model (chosen estimator for a trend + weekly season + noise series):
* value_t = intercept + slope * t + season[t mod 7] + noise, t = days since
  the series' first day; missing days are 0 (calendar gap fill).
* intercept/slope by OLS (``regr_intercept``/``regr_slope`` per series),
  season = mean residual per (series, t mod 7), sigma = sample std of what
  remains.
* Projection i = 1..h starts at the last observed value and adds the trend
  and the change in season: v_i = last + slope*i + season[(T+i)%7] - season[T%7],
  band = v_i -+ z * sigma * (1 + 0.015 i); value and lower floored at 0.

Every step is a groupBy or a join on the series key, so thousands of series
fit in one job. The calendar is bounded by (series x days in span).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: how fast the published bands widen a step.
BAND_GROWTH = 0.015


def check_horizon(h: int, max_horizon: int | None = None) -> int:
    """The number of steps asked for; below 1 or above ``max_horizon`` raises."""
    if h < 1 or (max_horizon is not None and h > max_horizon):
        raise ValueError(f"horizon must be at least 1{f' and at most {max_horizon}' if max_horizon else ''}, not {h}")
    return int(h)


def gap_fill(daily: DataFrame, series: str = "series", day: str = "day", value: str = "value",
             end=None) -> DataFrame:
    """One row per series and day from the series' first day to ``end``
    (default: newest day of all series); absent days get value 0."""
    spans = daily.groupBy(series).agg(F.min(day).alias("_d0"), F.max(day).alias("_d1"))
    if end is None:
        end = daily.agg(F.max(day)).first()[0]               # one scalar
    spans = spans.withColumn("_end", F.lit(end))
    cal = spans.select(series, F.explode(F.sequence("_d0", "_end")).alias(day))
    return cal.join(daily.select(series, day, value), [series, day], "left").select(
        series, day, F.coalesce(F.col(value), F.lit(0.0)).alias(value))


def fit(filled: DataFrame, series: str = "series", day: str = "day", value: str = "value"):
    """Returns (params, season): params per series (n, intercept, slope, sigma,
    last_day, last_t, last_value, and the weekday seasons as a <= 7-item
    array), season per (series, dow, season).

    Every step is a window or aggregate keyed by the series, so the filled
    series is shuffled once (hash on the series also clusters (series, dow)).
    A window partition holds one series' days: bounded by the calendar span,
    whatever the series' share of the raw data."""
    by_series = Window.partitionBy(series)
    d = filled.withColumn("t", F.datediff(F.col(day), F.min(day).over(by_series)))
    d = d.withColumn("_b0", F.regr_intercept(value, "t").over(by_series)) \
        .withColumn("_b1", F.regr_slope(value, "t").over(by_series))
    # fewer than two points: no trend line, so nothing is left to call season
    d = d.withColumn("resid", F.when(F.col("_b1").isNull(), F.lit(0.0))
                     .otherwise(F.col(value) - (F.col("_b0") + F.col("_b1") * F.col("t")))) \
        .withColumn("dow", F.col("t") % 7)
    d = d.withColumn("season", F.avg("resid").over(Window.partitionBy(series, "dow")))
    params = d.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.first("_b0").alias("intercept"), F.first("_b1").alias("slope"),
        F.stddev_samp(F.col("resid") - F.col("season")).alias("sigma"),
        F.max("t").alias("last_t"), F.max(day).alias("last_day"), F.max_by(value, "t").alias("last_value"),
        F.sort_array(F.collect_set(F.struct("dow", "season"))).alias("_s"))
    season = params.select(series, F.inline("_s"))
    return params, season


def fit_table(params: DataFrame, series: str = "series") -> DataFrame:
    """Fitted parameters rounded for reporting."""
    return params.select(series, "n", F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"),
                         F.round("sigma", 4).alias("sigma"), F.col("last_day").cast("timestamp_ntz").alias("last_day"),
                         "last_value")


def project(params: DataFrame, season: DataFrame, horizon: int = 30, z: float = 1.96,
            series: str = "series", max_horizon: int | None = None) -> DataFrame:
    """(series, step, day, value, lower, upper) for step 1..horizon."""
    h = check_horizon(horizon, max_horizon)
    if "_s" in params.columns:
        p = params                              # seasons already on the row (from ``fit``)
    else:
        s_arr = season.groupBy(series).agg(F.sort_array(F.collect_list(F.struct("dow", "season"))).alias("_s"))
        # at most 7 elements per series (one per weekday)
        p = params.join(s_arr, series)

    def s_at(t):
        return F.coalesce(F.try_element_at(F.filter("_s", lambda x: x["dow"] == t % 7), F.lit(1))["season"], F.lit(0.0))

    steps = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    v = F.col("last_value") + F.coalesce("slope", F.lit(0.0)) * F.col("step") \
        + s_at(F.col("last_t") + F.col("step")) - s_at(F.col("last_t"))
    w = z * F.coalesce("sigma", F.lit(0.0)) * (1 + BAND_GROWTH * F.col("step"))
    out = steps.select(series, "step", F.date_add("last_day", F.col("step")).alias("day"),
                       v.alias("_v"), w.alias("_w"))
    return out.select(series, "step", F.col("day").cast("timestamp_ntz").alias("day"),
                      F.round(F.greatest(F.lit(0.0), "_v"), 4).alias("value"),
                      F.round(F.greatest(F.lit(0.0), F.col("_v") - F.col("_w")), 4).alias("lower"),
                      F.round(F.col("_v") + F.col("_w"), 4).alias("upper"))


def forecast_series(filled: DataFrame, params: DataFrame, fc: DataFrame, series: str = "series",
                    day: str = "day", value: str = "value") -> DataFrame:
    """History + forecast, the last observed point repeated as the first
    forecast row (step 0) so the two lines join."""
    null = F.lit(None).cast("double")
    hist = filled.select(series, F.col(day).cast("timestamp_ntz").alias("day"), F.lit("history").alias("kind"),
                         F.lit(None).cast("int").alias("step"), F.col(value).alias("value"),
                         null.alias("lower"), null.alias("upper"))
    joint = params.select(series, F.col("last_day").cast("timestamp_ntz").alias("day"), F.lit("forecast").alias("kind"),
                          F.lit(0).alias("step"), F.col("last_value").alias("value"),
                          F.col("last_value").alias("lower"), F.col("last_value").alias("upper"))
    f = fc.select(series, "day", F.lit("forecast").alias("kind"), "step", "value", "lower", "upper")
    return hist.unionByName(joint).unionByName(f)


def forecast_summary(params: DataFrame, fc: DataFrame, series: str = "series") -> DataFrame:
    """direction, horizon, last history and forecast values, projected_change_pct."""
    last = fc.groupBy(series).agg(F.max("step").alias("horizon"), F.max_by("value", "step").alias("last_forecast"))
    j = params.join(last, series)
    return j.select(series, F.when(F.col("slope") > 0, "upward").otherwise("downward").alias("direction"),
                    "horizon", F.col("last_value").alias("last_history"), "last_forecast",
                    F.round((F.col("last_forecast") - F.col("last_value"))
                            / F.greatest(F.abs("last_value"), F.lit(1.0)) * 100, 2).alias("projected_change_pct"))


def backtest(filled: DataFrame, holdout: int = 14, z: float = 1.96, series: str = "series",
             day: str = "day", value: str = "value") -> DataFrame:
    """Hold out the last ``holdout`` days of each series, fit on the rest,
    forecast them: (series, points, mae, mape); zero actuals are left out of MAPE."""
    tagged = filled.withColumn("_end", F.max(day).over(Window.partitionBy(series))) \
        .withColumn("_test", F.col(day) > F.date_sub("_end", holdout))
    train = tagged.filter(~F.col("_test")).select(series, day, value)
    test = tagged.filter(F.col("_test")).select(series, F.col(day).cast("timestamp_ntz").alias("day"),
                                                 F.col(value).alias("actual"))
    params, season = fit(train, series, day, value)
    fc = project(params, season, horizon=holdout, z=z, series=series)
    j = test.join(fc.select(series, "day", "value"), [series, "day"])
    err = F.col("value") - F.col("actual")
    return j.groupBy(series).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.avg(F.abs(err)), 4).alias("mae"),
        F.round(F.avg(F.when(F.col("actual") != 0, F.abs(err) / F.abs("actual"))) * 100, 2).alias("mape"))


def forecast_metrics(daily: DataFrame, series: str = "series", unit: str = "USD") -> DataFrame:
    """The forecastable series with a display label and unit."""
    return daily.select(series).distinct().select(
        series, F.initcap(F.lower(F.col(series))).alias("label"), F.lit(unit).alias("unit"))
