"""Model lifecycle on MLlib: encode, split, train, evaluate, log, save/load,
predict, explain, cross-validate, registry views.

Training runs MLlib's distributed random forests on one sparse feature vector
per row; its dictionary of levels is exact at any number of levels. The
driver holds level lists, fitted models and metric values.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import (IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import NUMERIC_TYPES
from tessera.functions.exprs import spread as _spread
from tessera.operators.forest_cells import fit_on_cells
from tessera.operators.forest_scores import forest_votes

SEED = 42


# --------------------------------------------------------------------------
# encoding
def _feature_kinds(df: DataFrame, target: str | None, features: list[str] | None):
    feats = features if features is not None else [c for c in df.columns if c != target]
    cats = [c for c in feats if isinstance(df.schema[c].dataType, T.StringType)]
    nums = [c for c in feats if isinstance(df.schema[c].dataType, NUMERIC_TYPES + (T.BooleanType,))]
    return feats, nums, cats


def one_hot_encode(df: DataFrame, target: str | None = None, features: list[str] | None = None,
                   max_levels: int | None = None, keep: list[str] | None = None):
    """Drop-first dummy encoding in wide form.

    Features = every column but the target (or ``features``). String columns
    become one 0/1 column per level except the alphabetically first, named
    ``{col}_{level}``, whatever the number of levels; a null level is all
    zeros. With ``max_levels`` a column with more levels raises (the wide form
    makes a plan column per level; ``one_hot_vector`` does not). Numeric and
    bool columns are kept as double with null -> 0. Other types are dropped.
    Returns (encoded DataFrame, feature names); the target and ``keep``
    columns are carried through unchanged.
    """
    feats, nums, cats = _feature_kinds(df, target, features)
    levels: dict[str, list[str]] = {c: [] for c in cats}
    if cats:
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in cats])))
        for r in pairs.filter(F.col("v").isNotNull()).distinct().collect():
            levels[r["k"]].append(r["v"])
        for c in cats:
            if max_levels is not None and len(levels[c]) > max_levels:
                raise ValueError(f"column {c} has {len(levels[c])} levels, more than max_levels={max_levels}")
            levels[c].sort()
    # pandas order: untouched (numeric, bool) columns first, then the dummies
    out_cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in nums]
    names = list(nums)
    for c in cats:
        for level in levels[c][1:]:
            names.append(f"{c}_{level}")
            out_cols.append(F.coalesce((F.col(c) == F.lit(level)).cast("double"), F.lit(0.0)).alias(names[-1]))
    carry = [c for c in (keep or []) if c not in feats] + ([target] if target else [])
    return df.select(*[F.col(c) for c in carry], *out_cols), names


def one_hot_vector(df: DataFrame, target: str | None = None, features: list[str] | None = None,
                   keep: list[str] | None = None):
    """The encoding of ``one_hot_encode`` as one sparse vector column ``_features``.

    Same levels, same zeros for the alphabetically first level and for nulls,
    at any number of levels without a plan column per level. Returns
    (DataFrame with target, ``keep`` and ``_features``, names in vector order).
    """
    feats, nums, cats = _feature_kinds(df, target, features)
    carry = [c for c in (keep or []) if c != target] + ([target] if target else [])
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_n{i}") for i, c in enumerate(nums)]
    d = df.select(*carry, *cols, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cats)])
    names, parts = list(nums), [f"_n{i}" for i in range(len(nums))]
    if cats:
        first = df.agg(*[F.min(c).alias(f"_c{i}") for i, c in enumerate(cats)]).first()
        # an all-null column has no level and no feature
        used = [i for i in range(len(cats)) if first[i] is not None]
        d = d.fillna({f"_c{i}": first[i] for i in used})
        # descending order puts the alphabetically first level last, where dropLast drops it
        idx = StringIndexer(inputCols=[f"_c{i}" for i in used], outputCols=[f"_i{i}" for i in used],
                            stringOrderType="alphabetDesc").fit(d) if used else None
        several = [(i, lv) for i, lv in zip(used, idx.labelsArray if idx else [])  if len(lv) > 1]
        if several:
            enc = OneHotEncoder(inputCols=[f"_i{i}" for i, _ in several], outputCols=[f"_o{i}" for i, _ in several], dropLast=True)
            d = idx.transform(d)
            d = enc.fit(d).transform(d)
        for i, lv in several:
            names += [f"{cats[i]}_{v}" for v in lv[:-1]]
            parts.append(f"_o{i}")
    if not parts:
        raise ValueError("no usable feature columns")
    asm = VectorAssembler(inputCols=parts, outputCol="_features", handleInvalid="keep")
    return asm.transform(d).select(*carry, "_features"), names


# --------------------------------------------------------------------------
# split
def split_column(key: str | list[str], test_fraction: float = 0.2, seed: int = SEED) -> F.Column:
    """'test' / 'train' from an md5 of the key: stable under repartitioning,
    reruns and engines (``randomSplit`` is not)."""
    keys = [key] if isinstance(key, str) else key
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10000
    return F.when(bucket < int(round(test_fraction * 10000)), "test").otherwise("train")


def train_test_split(df: DataFrame, key, test_fraction: float = 0.2, seed: int = SEED):
    d = df.withColumn("_split", split_column(key, test_fraction, seed))
    return d.filter(F.col("_split") == "train").drop("_split"), d.filter(F.col("_split") == "test").drop("_split")


# --------------------------------------------------------------------------
# training
def _require(df: DataFrame, target: str):
    if target not in df.columns:
        raise ValueError("Target column not found")


# sklearn grows trees without a depth limit; MLlib allows 30 levels.
MAX_DEPTH = 30
MAX_MEMORY_MB = 256
# Node ids of every row are cached between levels instead of re-walking the
# trees (about 1/3 faster here); the cache's lineage is cut by a checkpoint
# every 10 levels in the shared checkpoint folder.


def _ensure_ckpt(spark: SparkSession) -> None:
    from tessera.session import _ensure_checkpoint_dir
    _ensure_checkpoint_dir(spark)


def _forest(kind: str, label: str, num_trees: int, max_depth: int, seed: int, params: dict | None):
    common = dict(featuresCol="_features", labelCol=label, numTrees=num_trees, maxDepth=max_depth, seed=seed,
                  maxMemoryInMB=MAX_MEMORY_MB, cacheNodeIds=True, checkpointInterval=10, **(params or {}))
    if kind == "classification":
        return RandomForestClassifier(featureSubsetStrategy="sqrt", predictionCol="_pred", probabilityCol="probability",
                                      rawPredictionCol="_raw", **common)
    return RandomForestRegressor(featureSubsetStrategy="all", predictionCol="prediction", **common)


def fit_forest(vectors: DataFrame, names: list[str], target: str, problem_type: str, labels_from: DataFrame,
               num_trees: int = 200, max_depth: int = MAX_DEPTH, seed: int = SEED, params: dict | None = None) -> PipelineModel:
    """Fit on ``_features`` vectors; the returned pipeline takes the wide feature columns ``names``.

    Class labels are indexed over ``labels_from`` (the whole label column, not
    the training part alone). Null labels raise. Many rows of few cells are grown on the
    cells (``forest_cells``), unless ``params`` ask for more than MLlib's defaults.
    """
    asm = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep")
    if not labels_from.filter(F.col(target).isNull()).isEmpty():
        raise ValueError(f"target column {target} has null values")
    if problem_type == "classification":
        idx = StringIndexer(inputCol=target, outputCol="_label", stringOrderType="alphabetAsc").fit(labels_from)
        return PipelineModel(stages=[idx, asm, _fit(idx.transform(vectors), problem_type, target, "_label", num_trees, max_depth, seed, params)])
    return PipelineModel(stages=[asm, _fit(vectors, problem_type, target, None, num_trees, max_depth, seed, params)])


def _fit(vectors: DataFrame, problem_type: str, target: str, label: str | None, num_trees: int, max_depth: int, seed: int, params: dict | None):
    forest = _forest(problem_type, label or target, num_trees, max_depth, seed, params)
    model = None
    if not params or params == {"minInstancesPerNode": 1}:
        columns = {"featuresCol": forest.getFeaturesCol(), "predictionCol": forest.getPredictionCol()}
        if label:
            columns |= {"probabilityCol": forest.getProbabilityCol(), "rawPredictionCol": forest.getRawPredictionCol()}
        model = fit_on_cells(vectors, target, label, columns, num_trees, max_depth, seed, MAX_MEMORY_MB)
    return model if model is not None else forest.fit(vectors)


def _labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def scorer(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline without its label indexer: scores rows that carry
    no target column."""
    return PipelineModel(stages=model.stages[1:]) if isinstance(model.stages[0], StringIndexerModel) else model


def _score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The forest's columns; rows carry the wide features or ``_features``. MLlib's scores, found a cell at a time."""
    forest, assemble = model.stages[-1], scorer(model)
    if "_features" in df.columns:
        assemble, x = None, vector_to_array("_features")
    else:
        x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in _assembled(assemble, df)])
    votes = forest_votes(df.sparkSession, forest, x) if assemble is None or _assembled(assemble, df) else None
    if votes is None:
        return (assemble or forest).transform(df)
    if not hasattr(forest, "numClasses"):
        return df.withColumn(forest.getPredictionCol(), votes[0])
    d = df.withColumn("_votes", votes)
    total = F.aggregate("_votes", F.lit(0.0), lambda s, v: s + v)
    return d.withColumns({
        forest.getRawPredictionCol(): array_to_vector("_votes"),
        forest.getProbabilityCol(): array_to_vector(F.when(total != 0, F.transform("_votes", lambda v: v / total)).otherwise(F.col("_votes"))),
        forest.getPredictionCol(): (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")}).drop("_votes")


def _assembled(model: PipelineModel, df: DataFrame) -> list[str]:
    """The columns that a pipeline of an assembler and a forest takes; none where they aren't all numbers."""
    if [type(s) for s in model.stages[:-1]] != [VectorAssembler]:
        return []
    names = model.stages[0].getInputCols()
    return names if all(isinstance(df.schema[c].dataType, NUMERIC_TYPES + (T.BooleanType,)) for c in names) else []


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """transform + original label strings in ``prediction``."""
    conv = IndexToString(inputCol="_pred", outputCol="prediction", labels=_labels(model))
    return conv.transform(_score(model, df))


def evaluate_classifier(model: PipelineModel, test: DataFrame) -> dict:
    """accuracy and weighted F1 from one confusion matrix (one scoring pass;
    the matrix has classes^2 cells). A row whose label the model does not know
    counts as a wrong one; null labels raise."""
    target = model.stages[0].getInputCol()
    pred = classify(model, test)
    cm = pred.groupBy(F.col(target).cast("string").alias("y"), F.col("prediction").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return _classifier_metrics(cm, target)


def _classifier_metrics(cm: list, target: str) -> dict:
    """accuracy and weighted F1 of a confusion matrix: rows y, p, n."""
    if any(r["y"] is None for r in cm):
        raise ValueError(f"target column {target} has null values")
    total = sum(r["n"] for r in cm)
    if total == 0:
        return {"accuracy": 0.0, "f1": 0.0}
    f1 = 0.0
    for c in {r["y"] for r in cm}:
        tp = sum(r["n"] for r in cm if r["y"] == c and r["p"] == c)
        actual = sum(r["n"] for r in cm if r["y"] == c)
        predicted = sum(r["n"] for r in cm if r["p"] == c)
        f1 += actual / total * 2 * tp / (actual + predicted)
    return {"accuracy": sum(r["n"] for r in cm if r["y"] == r["p"]) / total, "f1": f1}


#: Bytes of the scanned files that one task of a fit works on: a fit has a job a level, of as many tasks.
FIT_BYTES = 4 << 20


def spread(df: DataFrame, key: list[str] | None = None, bytes_each: int | None = None) -> DataFrame:
    """Training input spread over the cluster (a single small file would
    otherwise train in one task)."""
    return _spread(df, key, bytes_each)


def evaluate_regressor(model: PipelineModel, test: DataFrame, target: str) -> dict:
    """rmse and r2 from one aggregate over one scoring pass (r2 is 0.0 for a constant target)."""
    e = F.col(target).cast("double") - F.col("prediction")
    r = _score(model, test).agg(F.avg(e * e).alias("mse"), F.var_pop(F.col(target).cast("double")).alias("var")).first()
    mse, var = r["mse"] or 0.0, r["var"] or 0.0
    return {"rmse": mse ** 0.5, "r2": 1.0 - mse / var if var else 0.0}


def train(df: DataFrame, target: str, problem_type: str, model_type: str = "random_forest",
          key: str | list[str] | None = None, features: list[str] | None = None, test_fraction: float = 0.2,
          num_trees: int = 200, max_depth: int = MAX_DEPTH, seed: int = SEED, dataset_id: str | None = None) -> dict:
    """Encode, split, fit and score one model. ``problem_type`` 'classification'
    trains a classifier (accuracy), anything else a regressor (rmse).

    The target is checked before any Spark job runs. Returns a run record
    with the fitted ``PipelineModel`` under ``model``."""
    _require(df, target)
    keep = [key] if isinstance(key, str) else list(key or [])
    vec, names = one_hot_vector(df, target, features, keep=keep)
    _ensure_ckpt(df.sparkSession)
    from pyspark import StorageLevel
    split = split_column(keep, test_fraction, seed) if keep else split_column("_features_text", test_fraction, seed)
    if not keep:
        vec = vec.withColumn("_features_text", vector_to_array("_features").cast("string"))
    vec = spread(vec.withColumn("_split", split), keep or ["_features_text"], FIT_BYTES).persist(StorageLevel.MEMORY_AND_DISK)
    tr, te = vec.filter(F.col("_split") == "train"), vec.filter(F.col("_split") == "test")
    kind = "classification" if problem_type == "classification" else "regression"
    try:
        model = fit_forest(tr, names, target, kind, vec, num_trees, max_depth, seed)
        metrics = evaluate_classifier(model, te) if kind == "classification" else evaluate_regressor(model, te, target)
    finally:
        vec.unpersist()
    metric_name = "accuracy" if kind == "classification" else "rmse"
    # model name {model_type}_{dataset_id}; the target names it when no dataset id is given
    return {"run_id": uuid.uuid4().hex, "model_name": f"{model_type}_{dataset_id or target}", "model_type": model_type,
            "problem_type": problem_type, "target": target, "features": names, "metric_name": metric_name,
            "metric_value": float(metrics[metric_name]), "metrics": {k: float(v) for k, v in metrics.items()},
            "params": {"num_trees": str(num_trees), "max_depth": str(max_depth), "seed": str(seed),
                       "test_fraction": str(test_fraction)},
            "created_at": dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), "model": model}


RUN_SCHEMA = ("run_id string, model_name string, model_type string, problem_type string, target string, "
              "features array<string>, metric_name string, metric_value double, metrics map<string,double>, "
              "params map<string,string>, created_at timestamp_ntz, artifact string")


def run_record(spark: SparkSession, run: dict, artifact: str | None = None) -> DataFrame:
    row = (run["run_id"], run["model_name"], run["model_type"], run["problem_type"], run["target"],
           run["features"], run["metric_name"], run["metric_value"], run["metrics"], run["params"],
           run["created_at"], artifact)
    return spark.createDataFrame([row], RUN_SCHEMA)


def log_run(spark: SparkSession, runs_path: str, run: dict, artifact: str | None = None) -> None:
    """Append the run to the runs table (Parquet)."""
    run_record(spark, run, artifact).write.mode("append").parquet(runs_path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# --------------------------------------------------------------------------
# scoring
def align_features(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """Model features by name: missing -> 0.0, extra columns ignored."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in have else F.lit(0.0).alias(f)
            for f in features]
    return df.select(*[k for k in (keep or []) if k not in features], *cols)


def predict_batch(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str] | None = None,
                  problem_type: str = "classification") -> DataFrame:
    x = align_features(df, features, keep)
    if problem_type == "classification":
        return classify(model, x).select(*(keep or []), "prediction")
    return _score(model, x).select(*(keep or []), "prediction")


def predict_proba(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., class, probability): one row per class."""
    x = align_features(df, features, keep)
    out = _score(model, x)
    labels = F.array(*[F.lit(lbl) for lbl in _labels(model)])
    return out.select(*(keep or []), F.arrays_zip(labels.alias("class"), vector_to_array("probability").alias("probability"))
                      .alias("_z")).select(*(keep or []), F.inline("_z"))


# --------------------------------------------------------------------------
# explanation
def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """(rank, feature, importance) descending; uniform 1/n without importances."""
    est = model.stages[-1]
    imp = getattr(est, "featureImportances", None)
    vals = imp.toArray().tolist() if imp is not None else [1.0 / max(len(features), 1)] * len(features)
    df = spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature")   # one row per feature
    return df.select(F.row_number().over(w).alias("rank"), "feature", "importance")


def permute_column(df: DataFrame, col: str, key: list[str], seed: int = SEED, block_rows: int = 10000,
                   total_rows: int | None = None) -> DataFrame:
    """``col`` shuffled across rows, distributed: rows are hashed into blocks
    of about ``block_rows`` and the column is permuted inside each block
    (rank by one hash, re-attach by another). No global sort, no single task."""
    n = total_rows if total_rows is not None else df.count()
    return _paired(_hashed(df, key, seed, n, block_rows), [col], [c for c in df.columns if c != col])


def _hashed(df: DataFrame, key: list[str], seed: int, n: int, block_rows: int) -> DataFrame:
    """With the block of each of the ``n`` rows and its two hashes."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    return df.withColumn("_blk", F.pmod(h, F.lit(max(1, n // block_rows)))).withColumn("_h1", h) \
        .withColumn("_h2", F.xxhash64(F.lit(seed + 1), *[F.col(k) for k in key]))


def _paired(d: DataFrame, moved: list[str], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of each row with ``moved`` of another row of its block."""
    w1 = Window.partitionBy("_blk").orderBy("_h1", "_h2")
    w2 = Window.partitionBy("_blk").orderBy("_h2", "_h1")
    rows = d.select("_blk", F.row_number().over(w1).alias("_r"), *kept)
    vals = d.select("_blk", F.row_number().over(w2).alias("_r"), *moved)
    return rows.join(vals, ["_blk", "_r"]).drop("_blk", "_r")


def _forest_cuts(spark: SparkSession, forest, features: int) -> list[np.ndarray | None]:
    """The thresholds of each feature in all trees; None where values are categories, or the model is no forest."""
    if not isinstance(forest, (RandomForestClassificationModel, RandomForestRegressionModel)):
        return [None] * features
    from tessera.operators.attribution import forest_nodes
    cuts: list[np.ndarray | None] = [np.empty(0)] * features
    nodes = forest_nodes(spark, forest).filter("left >= 0").groupBy("feature").agg(
        F.max("levels").alias("levels"), F.collect_set(F.col("at")[0]).alias("at"))
    for r in nodes.collect():      # bounded by the model
        cuts[r["feature"]] = np.sort(r["at"]) if r["levels"] < 0 else None
    return cuts


def _stand_ins(rows: DataFrame, cuts: list[np.ndarray | None]) -> DataFrame:
    """``_x`` with each value replaced by the least threshold not below it (none: infinity, as for NaN):
    every split sends both to the same side, so all rows between the same thresholds become equal."""
    tops = [None if c is None else np.append(c, np.inf) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(tops))
            x = np.stack([x[:, j] if t is None else t[np.searchsorted(t[:-1], x[:, j], "left")] for j, t in enumerate(tops)], axis=1)
            size = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1])
            at = b.schema.get_field_index("_x")
            yield b.set_column(at, "_x", pa.ListArray.from_arrays(size, pa.array(x.ravel())))
    return rows.mapInArrow(run, rows.schema)


def permutation_importance(spark: SparkSession, model: PipelineModel, test: DataFrame, features: list[str],
                           key: list[str], problem_type: str = "classification", target: str | None = None,
                           seed: int = SEED) -> DataFrame:
    """(feature, baseline, permuted, importance): metric drop after permuting
    one feature (accuracy for classifiers, r2 for regressors).

    A row takes all its permuted values from one other row (that of ``permute_column``), so
    rows are paired once. The rows of a forest that lie between the same thresholds, with a
    feature permuted or none, are counted and scored as one."""
    clf = problem_type == "classification"
    y = model.stages[0].getInputCol() if clf else target
    cuts = _forest_cuts(spark, model.stages[-1], len(features))
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    label = F.col(f"`{y}`")
    rows = _hashed(test, key, seed, test.count(), 10000).select(
        "_blk", "_h1", "_h2", (label.cast("string") if clf else label.cast("double")).alias("_y"), x.alias("_x"))
    pairs = _paired(_stand_ins(rows, cuts).withColumn("_other", F.col("_x")), ["_other"], ["_x", "_y"])
    # _f: the permuted feature, 0 for none
    each = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("_f"))
    put = F.expr(f"concat(slice(_x, 1, greatest(_f - 1, 0)), slice(if(_f = 0, _x, _other), greatest(_f, 1), 1), slice(_x, greatest(_f, 1) + 1, {len(features)}))")
    each = each.select("_f", "_y", put.alias("_x"))
    if clf:
        cells = each.groupBy("_f", "_x", "_y").agg(F.count(F.lit(1)).alias("_n"))
    else:
        cells = each.groupBy("_f", "_x").agg(F.count("_y").alias("_n"), F.avg("_y").alias("_y"), F.var_pop("_y").alias("_v"))
    # few but costly rows: as many parts as tasks can run, which AQE would make one
    cells = cells.repartition(max(2, spark.sparkContext.defaultParallelism), "_x").withColumn("_features", array_to_vector("_x"))
    if clf:
        found = classify(model, cells).groupBy("_f", F.col("_y").alias("y"), F.col("prediction").alias("p")).agg(F.sum("_n").alias("n")).collect()
        scores = [_classifier_metrics([r for r in found if r["_f"] == f], y)["accuracy"] for f in range(len(features) + 1)]
    else:
        e = F.col("_y") - F.col("prediction")
        found = _score(model, cells).groupBy("_f").agg((F.sum(F.col("_n") * (e * e + F.col("_v"))) / F.sum("_n")).alias("mse")).collect()
        var = test.agg(F.var_pop(label.cast("double"))).first()[0] or 0.0
        mse = {r["_f"]: r["mse"] or 0.0 for r in found}
        scores = [1.0 - mse.get(f, 0.0) / var if var else 0.0 for f in range(len(features) + 1)]
    df = spark.createDataFrame([(f, float(scores[0]), float(s)) for f, s in zip(features, scores[1:])],
                               "feature string, baseline double, permuted double")
    return df.withColumn("importance", F.col("baseline") - F.col("permuted"))


def cross_validate(df: DataFrame, target: str, key: str | list[str], folds: int = 5, problem_type: str = "classification",
                   num_trees: int = 200, max_depth: int = MAX_DEPTH, seed: int = SEED, params: dict | str | None = None) -> DataFrame:
    """(fold, metric, score) for k folds assigned by key hash; the forest is the one ``train`` grows.

    ``params`` is a map (or its JSON text) of extra forest hyperparameters,
    e.g. ``{"minInstancesPerNode": 2, "subsamplingRate": 0.8}``."""
    from pyspark import StorageLevel
    if isinstance(params, str):
        import json
        params = json.loads(params) if params.strip() else None
    spark = df.sparkSession
    _require(df, target)
    keys = [key] if isinstance(key, str) else list(key)
    vec, names = one_hot_vector(df, target, keep=keys)
    _ensure_ckpt(spark)
    fold = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(folds))
    vec = spread(vec.withColumn("_fold", fold), keys, FIT_BYTES).persist(StorageLevel.MEMORY_AND_DISK)

    rows = []
    try:
        for k in range(folds):
            tr, te = vec.filter(F.col("_fold") != k), vec.filter(F.col("_fold") == k)
            m = fit_forest(tr, names, target, problem_type, vec, num_trees, max_depth, seed, params)
            if problem_type == "classification":
                rows.append((k, "accuracy", float(evaluate_classifier(m, te)["accuracy"])))
            else:
                rows.append((k, "rmse", float(evaluate_regressor(m, te, target)["rmse"])))
    finally:
        vec.unpersist()
    return spark.createDataFrame(rows, "fold int, metric string, score double")


# --------------------------------------------------------------------------
# registry views over the runs table
def model_leaderboard(runs: DataFrame, sort_by: str = "created_at", descending: bool = True) -> DataFrame:
    """Every run ordered by ``sort_by`` (any column of the result; ties by run_id): score
    (accuracy for classifiers, r2 for regressors), secondary (f1 or rmse), stage
    (newest per problem type = Production, others Staging)."""
    is_clf = F.col("problem_type") == "classification"
    score = F.when(is_clf, F.col("metrics")["accuracy"]).otherwise(F.col("metrics")["r2"])
    second = F.when(is_clf, F.col("metrics")["f1"]).otherwise(F.col("metrics")["rmse"])
    w = Window.partitionBy("problem_type").orderBy(F.desc("created_at"), "run_id")
    out = runs.select("run_id", "model_name", "model_type", F.size("features").alias("n_features"), "problem_type",
                      "target", "metric_name", "metric_value", F.round(score, 4).alias("score"),
                      F.round(second, 4).alias("secondary"), "created_at",
                      F.when(F.row_number().over(w) == 1, "Production").otherwise("Staging").alias("stage"))
    if sort_by not in out.columns:
        raise ValueError(f"sort_by must be one of {out.columns}")
    return out.orderBy(F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_last(), "run_id")


def registry_summary(runs: DataFrame) -> DataFrame:
    """Counts by problem type and by stage, and the mean classifier accuracy
    (0 when none)."""
    lb = model_leaderboard(runs).select("problem_type", "stage", F.col("score"))
    is_clf = F.col("problem_type") == "classification"
    return lb.agg(F.count(F.lit(1)).alias("models"), F.count(F.when(is_clf, 1)).alias("classifiers"),
                  F.count(F.when(~is_clf, 1)).alias("regressors"),
                  F.count(F.when(F.col("stage") == "Production", 1)).alias("production"),
                  F.count(F.when(F.col("stage") == "Staging", 1)).alias("staging"),
                  F.coalesce(F.round(F.avg(F.when(is_clf, F.col("score"))), 4), F.lit(0.0)).alias("mean_accuracy"))


def model_compare(runs: DataFrame, model_names: list[str]) -> DataFrame:
    """Rows = union of metric names, columns = models, absent -> '-'."""
    if len(model_names) < 2:
        raise ValueError("compare needs at least two models")
    m = runs.filter(F.col("model_name").isin(model_names)).select("model_name", F.explode("metrics").alias("metric", "value"))
    p = m.groupBy("metric").pivot("model_name", model_names).agg(F.first(F.round("value", 4).cast("string")))
    return p.select("metric", *[F.coalesce(F.col(f"`{n}`"), F.lit("-")).alias(n) for n in model_names])
