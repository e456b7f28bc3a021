"""Reports: long tables (section, item, metric, value) unioned from operators,
written as JSON, CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import anomaly as AN
from tessera.operators import ml as ML
from tessera.operators import monitoring as M
from tessera.operators import profile as P
from tessera.plans import fixtures as fx
from tessera.sources.files import table

REPORT_SCHEMA = "section string, item string, metric string, value double"


def _long(df: DataFrame, section: str, item, metrics: list[str]) -> DataFrame:
    item_col = item if not isinstance(item, str) else F.col(item).cast("string")
    return df.select(F.lit(section).alias("section"), item_col.alias("item"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def executive_summary(spark: SparkSession, sf_dir: str, period: int = 365, runs: DataFrame | None = None,
                      datasets: DataFrame | None = None) -> DataFrame:
    """One table of headline numbers: sales (revenue, orders, active customers
    in the period), traffic (events per minute, error rate, uptime), anomalies
    (open, critical) and, with a runs table and a dataset list, the mean model
    score and the number of datasets."""
    li, o, ev = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    kpi = A.kpi_summary(li, o, ev, period=period).filter(F.col("metric").isin("revenue", "orders", "customers"))
    sales = kpi.select(F.lit("executive_summary").alias("section"), F.lit("sales").alias("item"),
                       F.concat(F.col("metric"), F.lit(f"_{period}d")).alias("metric"), F.col("value"))
    traffic = _long(M.metrics_summary(ev, with_p99=False), "executive_summary", F.lit("platform"), ["events_per_min", "error_rate"]) \
        .unionByName(_long(M.uptime_percent(ev), "executive_summary", F.lit("platform"), ["uptime_pct"]))
    an = AN.anomaly_summary(AN.detect_anomalies(AN.anomaly_zscore(fx.metric_series(spark, sf_dir))))
    an = _long(an, "executive_summary", F.lit("anomalies"), ["total", "open", "critical"])
    out = sales.unionByName(traffic).unionByName(an)
    if runs is not None:
        score = ML.model_leaderboard(runs).agg(F.count(F.lit(1)).alias("models"), F.round(F.avg("score"), 4).alias("mean_score"))
        out = out.unionByName(_long(score, "executive_summary", F.lit("models"), ["models", "mean_score"]))
    if datasets is not None:
        out = out.unionByName(_long(datasets.agg(F.count(F.lit(1)).alias("datasets")), "executive_summary", F.lit("catalog"), ["datasets"]))
    return out


def profiling_charts(df: DataFrame, dataset: str) -> DataFrame:
    """Histogram counts and correlations of one dataset."""
    h = P.profile_histogram(df).select(F.lit("profiling_charts").alias("section"),
                                       F.concat_ws(".", F.lit(dataset), "column_name", F.col("bin").cast("string")).alias("item"),
                                       F.lit("count").alias("metric"), F.col("count").cast("double").alias("value"))
    c = P.profile_correlations(df).select(F.lit("profiling_charts").alias("section"),
                                          F.concat_ws(".", F.lit(dataset), "col_a", "col_b").alias("item"),
                                          F.lit("corr").alias("metric"), F.col("corr").alias("value"))
    return h.unionByName(c)


def ml_metrics(runs: DataFrame) -> DataFrame:
    return runs.select(F.lit("ml_metrics").alias("section"), F.col("model_name").alias("item"),
                       F.explode("metrics").alias("metric", "value"))


SECTIONS = ("executive_summary", "profiling_charts", "ml_metrics")


def report_dataset(spark: SparkSession, sf_dir: str, datasets: dict[str, DataFrame], runs: DataFrame | None,
                   sections=SECTIONS) -> DataFrame:
    parts = []
    if "executive_summary" in sections:
        parts.append(executive_summary(spark, sf_dir))
    if "profiling_charts" in sections:
        parts += [profiling_charts(df, name) for name, df in datasets.items()]
    if "ml_metrics" in sections and runs is not None:
        parts.append(ml_metrics(runs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(report: DataFrame, path: str, fmt: str = "json") -> str:
    w = report.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        w.json(path)
    return path
