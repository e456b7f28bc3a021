"""Forecast queries over daily revenue per market segment (gap-filled)."""

from __future__ import annotations

from tessera.operators import forecast as FC
from tessera.plans import fixtures as fx
from tessera.plans.registry import register

HORIZON = 30
HOLDOUT = 14


def _fill_ctes() -> str:
    return f"""ds AS ({fx.DAILY_SERIES_SQL}),
sp AS (SELECT series, min(day) AS d0 FROM ds GROUP BY 1),
en AS (SELECT max(day) AS e FROM ds),
cal AS (SELECT series, CAST(unnest(generate_series(d0, e, INTERVAL 1 DAY)) AS DATE) AS day FROM sp, en),
filled AS (SELECT cal.series, cal.day, coalesce(ds.value, 0.0) AS value FROM cal LEFT JOIN ds USING (series, day))"""


def _fit_ctes(src: str, p: str) -> str:
    return f"""{p}first AS (SELECT series, min(day) AS d0 FROM {src} GROUP BY 1),
{p}d AS (SELECT s.series, s.day, s.value, date_diff('day', f.d0, s.day) AS t FROM {src} s JOIN {p}first f USING (series)),
{p}ols AS (SELECT series, count(*) AS n, regr_intercept(value, t) AS intercept, regr_slope(value, t) AS slope,
              max(t) AS last_t, max(day) AS last_day, arg_max(value, t) AS last_value FROM {p}d GROUP BY 1),
{p}r AS (SELECT d.series, d.t, CASE WHEN o.slope IS NULL THEN 0.0 ELSE d.value - (o.intercept + o.slope * d.t) END AS resid,
                d.t % 7 AS dow
         FROM {p}d d JOIN {p}ols o USING (series)),
{p}se AS (SELECT series, dow, avg(resid) AS season FROM {p}r GROUP BY 1, 2),
{p}sg AS (SELECT r.series, stddev_samp(r.resid - s.season) AS sigma FROM {p}r r JOIN {p}se s USING (series, dow) GROUP BY 1),
{p}params AS (SELECT * FROM {p}ols JOIN {p}sg USING (series))"""


def _proj_ctes(p: str, h: int, z: float = 1.96) -> str:
    return f"""{p}steps AS (SELECT pr.*, CAST(unnest(range(1, {h} + 1)) AS INTEGER) AS step FROM {p}params pr),
{p}raw AS (SELECT st.series, st.step, CAST(st.last_day + st.step AS TIMESTAMP) AS day,
              st.last_value + coalesce(st.slope, 0.0) * st.step + coalesce(s1.season, 0.0) - coalesce(s0.season, 0.0) AS v,
              {z}::DOUBLE * coalesce(st.sigma, 0.0) * (1 + 0.015::DOUBLE * st.step) AS w
           FROM {p}steps st LEFT JOIN {p}se s1 ON s1.series = st.series AND s1.dow = (st.last_t + st.step) % 7
           LEFT JOIN {p}se s0 ON s0.series = st.series AND s0.dow = st.last_t % 7),
{p}proj AS (SELECT series, step, day, round(greatest(0.0, v), 4) AS value, round(greatest(0.0, v - w), 4) AS lower,
               round(v + w, 4) AS upper FROM {p}raw)"""


BASE = f"WITH {_fill_ctes()},\n{_fit_ctes('filled', '')}"


def _prep(spark, sf_dir):
    filled = FC.gap_fill(fx.daily_series(spark, sf_dir))
    params, season = FC.fit(filled)
    return filled, params, season


@register("forecast_fit", BASE + """
SELECT series, n, round(intercept, 4) AS intercept, round(slope, 4) AS slope, round(sigma, 4) AS sigma,
       CAST(last_day AS TIMESTAMP) AS last_day, last_value FROM params""")
def q_forecast_fit(spark, sf_dir):
    _, params, _ = _prep(spark, sf_dir)
    return FC.fit_table(params)


@register("forecast_season", BASE + "\nSELECT series, CAST(dow AS INTEGER) AS dow, round(season, 4) AS season FROM se")
def q_forecast_season(spark, sf_dir):
    from pyspark.sql import functions as F
    _, _, season = _prep(spark, sf_dir)
    return season.select("series", "dow", F.round("season", 4).alias("season"))


@register("forecast_project", BASE + ",\n" + _proj_ctes("", HORIZON) + "\nSELECT * FROM proj")
def q_forecast_project(spark, sf_dir):
    _, params, season = _prep(spark, sf_dir)
    return FC.project(params, season, horizon=HORIZON)


@register("forecast_series", BASE + ",\n" + _proj_ctes("", HORIZON) + """
SELECT series, CAST(day AS TIMESTAMP) AS day, 'history' AS kind, CAST(NULL AS INTEGER) AS step, value,
       CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM filled
UNION ALL
SELECT series, CAST(last_day AS TIMESTAMP), 'forecast', 0, last_value, last_value, last_value FROM params
UNION ALL
SELECT series, day, 'forecast', step, value, lower, upper FROM proj""")
def q_forecast_series(spark, sf_dir):
    filled, params, season = _prep(spark, sf_dir)
    return FC.forecast_series(filled, params, FC.project(params, season, horizon=HORIZON))


@register("forecast_summary", BASE + ",\n" + _proj_ctes("", HORIZON) + """
SELECT p.series, CASE WHEN p.slope > 0 THEN 'upward' ELSE 'downward' END AS direction, l.horizon,
       p.last_value AS last_history, l.last_forecast,
       round((l.last_forecast - p.last_value) / greatest(abs(p.last_value), 1.0) * 100, 2) AS projected_change_pct
FROM params p JOIN (SELECT series, max(step) AS horizon, arg_max(value, step) AS last_forecast FROM proj GROUP BY 1) l
USING (series)""")
def q_forecast_summary(spark, sf_dir):
    _, params, season = _prep(spark, sf_dir)
    return FC.forecast_summary(params, FC.project(params, season, horizon=HORIZON))


@register("forecast_backtest", f"WITH {_fill_ctes()},\n" + f"""
ends AS (SELECT series, max(day) AS e FROM filled GROUP BY 1),
tagged AS (SELECT f.*, f.day > CAST(e - INTERVAL {HOLDOUT} DAY AS DATE) AS is_test FROM filled f JOIN ends USING (series)),
train AS (SELECT series, day, value FROM tagged WHERE NOT is_test),
test AS (SELECT series, CAST(day AS TIMESTAMP) AS day, value AS actual FROM tagged WHERE is_test),
""" + _fit_ctes("train", "b_") + ",\n" + _proj_ctes("b_", HOLDOUT) + """
SELECT t.series, count(*) AS points, round(avg(abs(p.value - t.actual)), 4) AS mae,
       round(avg(CASE WHEN t.actual <> 0 THEN abs(p.value - t.actual) / abs(t.actual) END) * 100, 2) AS mape
FROM test t JOIN b_proj p USING (series, day) GROUP BY 1""")
def q_forecast_backtest(spark, sf_dir):
    filled = FC.gap_fill(fx.daily_series(spark, sf_dir))
    return FC.backtest(filled, holdout=HOLDOUT)


@register("forecast_metrics", f"""
WITH ds AS ({fx.DAILY_SERIES_SQL})
SELECT DISTINCT series, upper(left(series, 1)) || lower(substr(series, 2)) AS label, 'USD' AS unit FROM ds""")
def q_forecast_metrics(spark, sf_dir):
    return FC.forecast_metrics(fx.daily_series(spark, sf_dir))
