"""ML lifecycle and drift queries.

Classifier: orders_dummies (label = o_totalprice > 250000). Regressor:
lineitem l_extendedprice from quantity, discount, tax, flags. Fitted models
are kept with the session that fitted them, so the queries that explain or
score a model reuse one fit.
"""

from __future__ import annotations

import weakref

from pyspark.sql import functions as F

from tessera.operators import attribution as AT
from tessera.operators import drift as D
from tessera.operators import ml as ML
from tessera.plans import fixtures as fx
from tessera.plans.registry import register
from tessera.session import scratch_dir
from tessera.sources.files import table

# Depth of the forests of these queries (the library's default is 30, see the README for times).
QUERY_DEPTH = 10
# session -> {(sf_dir, kind): run}; a session that ends takes its models along
_SESSIONS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _models(spark) -> dict:
    return _SESSIONS.setdefault(spark, {})


def _clf(spark, sf_dir):
    models, k = _models(spark), (sf_dir, "clf")
    if k not in models:
        models[k] = ML.train(fx.orders_dummies(spark, sf_dir), "label", "classification",
                              model_type="random_forest", key="o_orderkey", max_depth=QUERY_DEPTH)
    return models[k]


def _lineitem_reg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_extendedprice")


def _reg(spark, sf_dir):
    models, k = _models(spark), (sf_dir, "reg")
    if k not in models:
        models[k] = ML.train(_lineitem_reg(spark, sf_dir), "l_extendedprice", "regression",
                              model_type="random_forest", key=["l_orderkey", "l_linenumber"],
                              features=["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], max_depth=QUERY_DEPTH)
    return models[k]


def _runs(spark, sf_dir):
    models, k = _models(spark), (sf_dir, "runs")
    if k not in models:
        path = scratch_dir(spark, "runs")
        for run in (_clf(spark, sf_dir), _reg(spark, sf_dir)):
            art = save_path = f"{path}-models/{run['model_name']}"
            ML.save_model(run["model"], save_path)
            ML.log_run(spark, path, run, art)
        models[k] = path
    return spark.read.parquet(models[k])


def _run_row(spark, run):
    return ML.run_record(spark, run).drop("artifact")


# -- encoding ----------------------------------------------------------------
@register("one_hot_encode", f"""
WITH od AS ({fx.ORDERS_DUMMIES_SQL})
SELECT label, CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  coalesce(CAST(o_orderstatus = 'O' AS DOUBLE), 0.0) AS o_orderstatus_O,
  coalesce(CAST(o_orderstatus = 'P' AS DOUBLE), 0.0) AS o_orderstatus_P,
  coalesce(CAST(o_orderpriority = '2-HIGH' AS DOUBLE), 0.0) AS "o_orderpriority_2-HIGH",
  coalesce(CAST(o_orderpriority = '3-MEDIUM' AS DOUBLE), 0.0) AS "o_orderpriority_3-MEDIUM",
  coalesce(CAST(o_orderpriority = '4-NOT SPECIFIED' AS DOUBLE), 0.0) AS "o_orderpriority_4-NOT SPECIFIED",
  coalesce(CAST(o_orderpriority = '5-LOW' AS DOUBLE), 0.0) AS "o_orderpriority_5-LOW"
FROM od""")
def q_one_hot_encode(spark, sf_dir):
    enc, _ = ML.one_hot_encode(fx.orders_dummies(spark, sf_dir), target="label")
    return enc


@register("train_test_split", f"""
SELECT *, CASE WHEN ('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 10000 < 2000
          THEN 'test' ELSE 'train' END AS split FROM ({fx.ORDERS_DUMMIES_SQL})""")
def q_train_test_split(spark, sf_dir):
    od = fx.orders_dummies(spark, sf_dir)
    return od.withColumn("split", ML.split_column("o_orderkey", 0.2))


# -- training, registry -------------------------------------------------------
@register("train_classifier")
def q_train_classifier(spark, sf_dir):
    return _run_row(spark, _clf(spark, sf_dir))


@register("train_regressor")
def q_train_regressor(spark, sf_dir):
    return _run_row(spark, _reg(spark, sf_dir))


@register("run_log", f"""
SELECT run_id, model_name, model_type, problem_type, target, metric_name, metric_value, created_at FROM ({fx.EVENT_RUNS_SQL})""")
def q_run_log(spark, sf_dir):
    """Runs appended to the runs table in two writes and read back."""
    path = scratch_dir(spark, "runs")
    runs = fx.event_runs(spark, sf_dir)
    for part in (F.col("problem_type") == "classification", F.col("problem_type") != "classification"):
        runs.filter(part).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("run_id", "model_name", "model_type", "problem_type", "target", "metric_name",
                                           "metric_value", "created_at")


@register("run_log_trained")
def q_run_log_trained(spark, sf_dir):
    return _runs(spark, sf_dir)


def _scoring_input(spark, sf_dir):
    """orders_dummies encoded for scoring, with the order key carried as ``key``
    (o_orderkey itself is also a model feature, as a double)."""
    od = fx.orders_dummies(spark, sf_dir).withColumn("key", F.col("o_orderkey"))
    feats = [c for c in od.columns if c not in ("label", "key")]
    enc, _ = ML.one_hot_encode(od, target="label", features=feats, keep=["key"])
    return enc


def _as_order_key(df):
    return df.withColumnRenamed("key", "o_orderkey")


@register("model_save_load")
def q_model_save_load(spark, sf_dir):
    runs = _runs(spark, sf_dir).filter(F.col("problem_type") == "classification").first()
    model = ML.load_model(runs["artifact"])
    x = ML.align_features(_scoring_input(spark, sf_dir), list(runs["features"]), keep=["key", "label"])
    return _as_order_key(ML.classify(model, x).select("key", "label", "prediction"))


@register("model_save")
def q_model_save(spark, sf_dir):
    """Saved artifacts: one row per fitted model with its path (overwrite on save)."""
    return _runs(spark, sf_dir).select("model_name", "model_type", "problem_type", "target", "features", "artifact")


@register("model_load")
def q_model_load(spark, sf_dir):
    """Every saved model loaded back and applied to its own input."""
    runs = _runs(spark, sf_dir)
    out = None
    for r in runs.collect():                       # one row per saved model
        model = ML.load_model(r["artifact"])
        if r["problem_type"] == "classification":
            x = ML.align_features(_scoring_input(spark, sf_dir), list(r["features"]), keep=["key"])
            pred = ML.classify(model, x).select(F.col("key").cast("string").alias("row_key"),
                                                F.col("prediction").cast("string").alias("prediction"))
        else:
            li = _lineitem_reg(spark, sf_dir).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
            enc, _ = ML.one_hot_encode(li, target="l_extendedprice", keep=["key"],
                                       features=["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
            x = ML.align_features(enc, list(r["features"]), keep=["key"])
            pred = ML.predict_batch(model, x, list(r["features"]), keep=["key"], problem_type=r["problem_type"]).select(
                F.col("key").alias("row_key"), F.round("prediction", 4).cast("string").alias("prediction"))
        pred = pred.select(F.lit(r["model_name"]).alias("model_name"), "row_key", "prediction")
        out = pred if out is None else out.unionByName(pred)
    return out


@register("predict_batch")
def q_predict_batch(spark, sf_dir):
    run = _clf(spark, sf_dir)
    # features by name: a missing one would be 0.0, extra columns (label) are ignored
    return _as_order_key(ML.predict_batch(run["model"], _scoring_input(spark, sf_dir), run["features"], keep=["key"]))


@register("predict_proba")
def q_predict_proba(spark, sf_dir):
    run = _clf(spark, sf_dir)
    return _as_order_key(ML.predict_proba(run["model"], _scoring_input(spark, sf_dir), run["features"], keep=["key"]))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    run = _clf(spark, sf_dir)
    return ML.feature_importance(spark, run["model"], run["features"])


@register("shap_like")
def q_shap_like(spark, sf_dir):
    run = _clf(spark, sf_dir)
    od, _ = ML.one_hot_encode(fx.orders_dummies(spark, sf_dir), target="label", keep=["o_orderkey"])
    _, test = ML.train_test_split(od, "o_orderkey", 0.2)
    return ML.permutation_importance(spark, run["model"], test, run["features"], ["o_orderkey"])


def _explained(spark, sf_dir):
    run = _clf(spark, sf_dir)
    od = fx.orders_dummies(spark, sf_dir).withColumn("key", F.col("o_orderkey"))
    feats = [c for c in od.columns if c not in ("label", "key")]
    enc, _ = ML.one_hot_encode(od, target="label", features=feats, keep=["key"])
    _, test = ML.train_test_split(enc, "key", 0.2)
    return AT.attributions(run["model"], ML.spread(test, ["key"]), run["features"], ["key"])


@register("shap_values")
def q_shap_values(spark, sf_dir):
    """Attributions of every prediction for the test part: they add up to prediction - base."""
    return _as_order_key(_explained(spark, sf_dir))


@register("shap_summary")
def q_shap_summary(spark, sf_dir):
    return AT.attribution_summary(_explained(spark, sf_dir))


@register("cross_validate")
def q_cross_validate(spark, sf_dir):
    return ML.cross_validate(fx.orders_dummies(spark, sf_dir), "label", "o_orderkey", folds=5, max_depth=QUERY_DEPTH,
                             params='{"minInstancesPerNode": 1}')


LEADERBOARD_SQL = f"""
SELECT run_id, model_name, model_type, 2 AS n_features, problem_type, target, metric_name, metric_value,
       round(CASE WHEN problem_type = 'classification' THEN share ELSE 1 - share END, 4) AS score,
       round(CASE WHEN problem_type = 'classification' THEN share / 2 ELSE mean END, 4) AS secondary, created_at,
       CASE WHEN row_number() OVER (PARTITION BY problem_type ORDER BY created_at DESC, run_id) = 1 THEN 'Production'
            ELSE 'Staging' END AS stage
FROM ({fx.EVENT_RUNS_SQL})"""


@register("model_leaderboard", LEADERBOARD_SQL)
def q_model_leaderboard(spark, sf_dir):
    return ML.model_leaderboard(fx.event_runs(spark, sf_dir), sort_by="score")


@register("model_leaderboard_trained")
def q_model_leaderboard_trained(spark, sf_dir):
    return ML.model_leaderboard(_runs(spark, sf_dir))


@register("model_registry_summary", f"""
SELECT count(*) AS models, count(*) FILTER (problem_type = 'classification') AS classifiers,
       count(*) FILTER (problem_type <> 'classification') AS regressors, count(*) FILTER (stage = 'Production') AS production,
       count(*) FILTER (stage = 'Staging') AS staging,
       coalesce(round(avg(score) FILTER (problem_type = 'classification'), 4), 0.0) AS mean_accuracy
FROM ({LEADERBOARD_SQL})""")
def q_model_registry_summary(spark, sf_dir):
    return ML.registry_summary(fx.event_runs(spark, sf_dir))


@register("model_compare", f"""
WITH r AS (SELECT * FROM ({fx.EVENT_RUNS_SQL}) QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY created_at DESC, run_id) = 1),
m AS (SELECT model_name, 'accuracy' AS metric, share AS v FROM r WHERE problem_type = 'classification'
      UNION ALL SELECT model_name, 'f1', share / 2 FROM r WHERE problem_type = 'classification'
      UNION ALL SELECT model_name, 'r2', 1 - share FROM r WHERE problem_type <> 'classification'
      UNION ALL SELECT model_name, 'rmse', mean FROM r WHERE problem_type <> 'classification')
SELECT metric, coalesce(max(round(v, 4)) FILTER (model_name = 'model_error'), -1) AS model_error,
       coalesce(max(round(v, 4)) FILTER (model_name = 'model_purchase'), -1) AS model_purchase
FROM m WHERE model_name IN ('model_error', 'model_purchase') GROUP BY metric""")
def q_model_compare(spark, sf_dir):
    from pyspark.sql import Window
    runs = fx.event_runs(spark, sf_dir)
    newest = Window.partitionBy("model_name").orderBy(F.desc("created_at"), "run_id")
    runs = runs.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    names = ["model_error", "model_purchase"]
    out = ML.model_compare(runs, names)
    # the operator's '-' for an absent metric as -1, so that both engines return numbers
    return out.select("metric", *[F.when(F.col(n) == "-", F.lit(-1.0)).otherwise(F.col(n).cast("double")).alias(n) for n in names])


# -- drift ---------------------------------------------------------------------
def _psi_sql(src: str, feature: str, p: str = "") -> str:
    bins = " + ".join(f"CAST(s.value > edges[{k}] AS INTEGER)" for k in range(1, 10))
    return f"""
{p}ed AS (SELECT {feature} AS feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges
       FROM {src} WHERE "window" = 'baseline' GROUP BY 1),
{p}bn AS (SELECT s.{feature} AS feature, s."window" AS w, {bins} AS bin
       FROM {src} s JOIN {p}ed e ON s.{feature} = e.feature),
{p}cn AS (SELECT feature, w, bin, count(*) AS n FROM {p}bn GROUP BY 1, 2, 3),
{p}sh AS (SELECT feature, w, bin, n / sum(n) OVER (PARTITION BY feature, w) AS share FROM {p}cn),
{p}gr AS (SELECT feature, unnest(range(10)) AS bin FROM {p}ed),
{p}g AS (SELECT gr.feature, greatest(coalesce(a.share, 0.0), 1e-6) AS p, greatest(coalesce(b.share, 0.0), 1e-6) AS q
      FROM {p}gr gr LEFT JOIN {p}sh a ON a.feature = gr.feature AND a.bin = gr.bin AND a.w = 'baseline'
      LEFT JOIN {p}sh b ON b.feature = gr.feature AND b.bin = gr.bin AND b.w = 'current'),
{p}psi AS (SELECT feature, round(sum((q - p) * ln(q / p)), 4) AS psi FROM {p}g GROUP BY 1)"""


FEATURE_DRIFT_CTE = f"ew AS ({fx.EVENTS_WINDOWS_SQL}),{_psi_sql('ew', 'event_type')}"
PRED_DRIFT_CTE = (f"ewp AS (SELECT 'value' AS feature, \"window\", value FROM ({fx.EVENTS_WINDOWS_SQL})),"
                  + _psi_sql("ewp", "feature", "p"))
PSI_STATUS = "CASE WHEN psi > 0.05 THEN 'WARNING' ELSE 'OK' END"


def _windows(spark, sf_dir):
    return fx.events_windows(spark, sf_dir)


def _feature_drift(spark, sf_dir):
    return D.feature_psi(_windows(spark, sf_dir), "event_type", "window", "value")


def _prediction_drift(spark, sf_dir):
    return D.column_psi(_windows(spark, sf_dir), ["value"], F.col("window"))


@register("feature_drift", f"WITH {FEATURE_DRIFT_CTE}\nSELECT feature, psi, {PSI_STATUS} AS status FROM psi")
def q_feature_drift(spark, sf_dir):
    return _feature_drift(spark, sf_dir)


@register("prediction_drift", f"WITH {PRED_DRIFT_CTE}\nSELECT feature, psi, {PSI_STATUS} AS status FROM ppsi")
def q_prediction_drift(spark, sf_dir):
    return _prediction_drift(spark, sf_dir)


@register("drift_report", f"""WITH {FEATURE_DRIFT_CTE}, {PRED_DRIFT_CTE}
SELECT 'events_value_model' AS model_name, f.feature_drift_score, p.prediction_drift_score,
       CASE WHEN greatest(f.feature_drift_score, p.prediction_drift_score) > 0.05 THEN 'WARNING' ELSE 'OK' END AS status,
       f.drifted_features
FROM (SELECT max(psi) AS feature_drift_score,
             coalesce(list(feature ORDER BY feature) FILTER (WHERE psi > 0.05), []) AS drifted_features FROM psi) f,
     (SELECT max(psi) AS prediction_drift_score FROM ppsi) p""")
def q_drift_report(spark, sf_dir):
    return D.drift_report(_feature_drift(spark, sf_dir), _prediction_drift(spark, sf_dir), "events_value_model")


@register("drift_alerts", f"""WITH {FEATURE_DRIFT_CTE}
SELECT 'events_value_model' AS model_name, feature, psi, CASE WHEN psi > 0.2 THEN 'error' ELSE 'warning' END AS severity,
       printf('%s: %s drift = %s%%', 'events_value_model', feature, format('{{:.1f}}', round(psi * 100, 1))) AS message
FROM psi WHERE psi > 0.05""")
def q_drift_alerts(spark, sf_dir):
    return D.drift_alerts(_feature_drift(spark, sf_dir), "events_value_model")


EVENTS_NULLS_WINDOWS_SQL = f"""SELECT event_type, "window", value FROM ({fx.EVENTS_WINDOWS_SQL})
UNION ALL SELECT event_type, 'current', NULL FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_type, 'baseline', 'NaN'::DOUBLE FROM events WHERE event_id % 7 = 0"""


@register("feature_drift_nulls", f"""WITH ew AS (SELECT * FROM ({EVENTS_NULLS_WINDOWS_SQL}) WHERE value IS NOT NULL AND NOT isnan(value)),
{_psi_sql('ew', 'event_type').strip()}
SELECT feature, psi, {PSI_STATUS} AS status FROM psi""")
def q_feature_drift_nulls(spark, sf_dir):
    """Drift with missing values added to both windows: the same as without them."""
    w = _windows(spark, sf_dir).select("event_type", "window", F.col("value").cast("double").alias("value"))
    e = table(spark, sf_dir, "events")
    nulls = e.filter(F.col("event_id") % 3 == 0).select("event_type", F.lit("current").alias("window"), F.lit(None).cast("double").alias("value"))
    nans = e.filter(F.col("event_id") % 7 == 0).select("event_type", F.lit("baseline").alias("window"), F.lit(float("nan")).alias("value"))
    return D.feature_psi(w.unionByName(nulls).unionByName(nans), "event_type", "window", "value")


# -- drift over real feature columns ---------------------------------------------------
COLUMN_DRIFT_SRC = """
SELECT f AS feature, CASE WHEN l_shipdate < (SELECT min(l_shipdate) + (max(l_shipdate) - min(l_shipdate)) / 2 FROM lineitem)
                          THEN 'baseline' ELSE 'current' END AS "window", v AS value
FROM (SELECT l_shipdate, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS f,
             unnest([CAST(l_quantity AS DOUBLE), l_extendedprice, l_discount, l_tax]) AS v FROM lineitem)"""


@register("feature_drift_columns", f"""WITH ew AS ({COLUMN_DRIFT_SRC}),{_psi_sql('ew', 'feature')}
SELECT feature, psi, {PSI_STATUS} AS status FROM psi""")
def q_feature_drift_columns(spark, sf_dir):
    """One feature per numeric column of lineitem, the older half of the ship dates against the newer one."""
    li = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lo, hi = li.agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    return D.column_psi(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                        F.when(F.col("l_shipdate") < D.middle(lo, hi), "baseline").otherwise("current"))
