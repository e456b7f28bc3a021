"""Report queries."""

from __future__ import annotations

from tessera.plans import fixtures as fx
from tessera.plans.daily import daily_run
from tessera.plans.q_analytics import _kpi_sql
from tessera.plans.q_anomaly import ANOMS_SQL
from tessera.plans.q_monitoring import HOURLY_SQL
from tessera.plans.registry import register
from tessera.plans.reports import report_dataset
from tessera.sources.files import table

def _exec_sql() -> str:
    kpi = _kpi_sql(365).strip()
    anoms = ANOMS_SQL.strip()
    return f"""
WITH kpi AS ({kpi}),
an_src AS ({anoms}
SELECT * FROM an),
hr AS ({HOURLY_SQL}),
ms AS (SELECT round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 0), 2) AS events_per_min,
              coalesce(round(count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / nullif(count(*), 0), 2), 0.0) AS error_rate
       FROM events),
up AS (SELECT round((count(*) - count(*) FILTER (WHERE error_rate > 25.0)) * 100.0::DOUBLE / nullif(count(*), 0), 2) AS uptime_pct FROM hr)
SELECT 'executive_summary' AS section, 'sales' AS item, metric || '_365d' AS metric, value FROM kpi
WHERE metric IN ('revenue', 'orders', 'customers')
UNION ALL SELECT 'executive_summary', 'platform', 'events_per_min', events_per_min FROM ms
UNION ALL SELECT 'executive_summary', 'platform', 'error_rate', error_rate FROM ms
UNION ALL SELECT 'executive_summary', 'platform', 'uptime_pct', uptime_pct FROM up
UNION ALL SELECT 'executive_summary', 'anomalies', 'total', CAST(count(*) AS DOUBLE) FROM an_src
UNION ALL SELECT 'executive_summary', 'anomalies', 'open', CAST(count(*) FILTER (WHERE status = 'open') AS DOUBLE) FROM an_src
UNION ALL SELECT 'executive_summary', 'anomalies', 'critical', CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS DOUBLE) FROM an_src"""


def _exec_models_sql() -> str:
    from tessera.plans.q_ml import LEADERBOARD_SQL
    return f"""{_exec_sql()}
UNION ALL SELECT 'executive_summary', 'models', 'models', CAST(count(*) AS DOUBLE) FROM ({LEADERBOARD_SQL})
UNION ALL SELECT 'executive_summary', 'models', 'mean_score', round(avg(score), 4) FROM ({LEADERBOARD_SQL})
UNION ALL SELECT 'executive_summary', 'catalog', 'datasets', CAST(2 AS DOUBLE)"""


def _summary(spark, sf_dir):
    from tessera.plans.reports import executive_summary
    from tessera.session import scratch_dir
    from tessera.sources import catalog as C
    cat = scratch_dir(spark, "catalog")
    for names in (["orders"], ["events", "orders"]):          # orders registered twice: one dataset
        C.register_datasets(spark, cat, [(t, "parquet", f"{sf_dir.rstrip('/')}/{t}.parquet", table(spark, sf_dir, t)) for t in names])
    return executive_summary(spark, sf_dir, runs=fx.event_runs(spark, sf_dir), datasets=C.list_datasets(spark, cat))


@register("executive_summary", _exec_models_sql())
def q_executive_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


def _sections_sql() -> str:
    return f"SELECT * FROM ({_exec_sql()}) UNION ALL SELECT * FROM ({_charts_sql()})"


@register("report_dataset")
def q_report_dataset(spark, sf_dir):
    from tessera.plans.q_ml import _runs
    return report_dataset(spark, sf_dir, {"orders": table(spark, sf_dir, "orders"),
                                          "events_nulls": fx.events_nulls(spark, sf_dir)}, _runs(spark, sf_dir))


@register("daily_run")
def q_daily_run(spark, sf_dir):
    return daily_run(spark, sf_dir)


ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


def _charts_sql() -> str:
    from tessera.plans.q_profile import _corr_sql, _hist_sql
    return f"""
WITH h AS ({_hist_sql("orders", ORDERS_NUM)}),
c AS ({_corr_sql("orders", ORDERS_NUM)})
SELECT 'profiling_charts' AS section, 'orders.' || column_name || '.' || CAST(bin AS VARCHAR) AS item,
       'count' AS metric, CAST("count" AS DOUBLE) AS value FROM h
UNION ALL
SELECT 'profiling_charts', 'orders.' || col_a || '.' || col_b, 'corr', corr FROM c"""


@register("report_profiling_charts", _charts_sql())
def q_report_profiling_charts(spark, sf_dir):
    from tessera.plans.reports import profiling_charts
    return profiling_charts(table(spark, sf_dir, "orders"), "orders")


@register("report_sections", _sections_sql())
def q_report_sections(spark, sf_dir):
    """The report without the model section: every row has a SQL form."""
    return report_dataset(spark, sf_dir, {"orders": table(spark, sf_dir, "orders")}, None, sections=("executive_summary", "profiling_charts"))
