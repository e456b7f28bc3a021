"""Scores found a cell at a time against MLlib's own transform."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators import forest_cells as FC
from tessera.operators import forest_scores as FS
from tessera.operators import ml as ML


@pytest.fixture(scope="module")
def rows(spark):
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 for i in range(3)]
    kind = F.element_at(F.array(*[F.lit(k) for k in "xyz"]), (h[2] * 3).cast("int") + 1)
    d = spark.range(4000).select("id", h[0].alias("a"), F.floor(h[1] * 9).alias("b"), kind.alias("kind"))
    y = 10 * F.col("a") + F.when(F.col("kind") == "z", 4.0).otherwise(0.0) + F.col("b")
    return d.withColumn("y", y).withColumn("label", F.when(y > 9, "yes").when(y > 6, "perhaps").otherwise("no"))


@pytest.mark.parametrize("on_cells", [False, True])
@pytest.mark.parametrize("places", [FS.PLACES, 0])
@pytest.mark.parametrize("kind, target", [("classification", "label"), ("regression", "y")])
def test_scores_equal_mllib(spark, rows, kind, target, places, on_cells, monkeypatch):
    monkeypatch.setattr(FC, "ROWS", 0 if on_cells else FC.ROWS)
    monkeypatch.setattr(FS, "PLACES", places)
    run = ML.train(rows.select("id", "a", "b", "kind", target), target, kind, key="id", features=["a", "b", "kind"], num_trees=7, max_depth=6)
    enc, _ = ML.one_hot_encode(rows, features=["a", "b", "kind"], keep=["id"])
    odd = spark.createDataFrame([(-1, None, 1.0, 0.5, 0.0), (-2, float("nan"), None, 1.0, 1.0), (-3, float("inf"), -1e9, float("nan"), 2.0)],
                                "id long, a double, b double, kind_y double, kind_z double")
    x = enc.unionByName(odd).repartition(3)
    forest = run["model"].stages[-1]
    assert FS.forest_votes(spark, forest, F.array()) is not None
    columns = ["prediction"] if kind == "regression" else ["_pred", "_raw", "probability"]

    def listed(d):
        plain = [vector_to_array(c).alias(c) if c in ("_raw", "probability") else F.col(c) for c in columns]
        return sorted(map(tuple, d.select("id", *plain).collect()))
    got = listed(ML._score(run["model"], x))
    assert len(got) == 4003 and got == listed(ML.scorer(run["model"]).transform(x))


def test_other_models_are_scored_by_mllib(spark, rows, monkeypatch):
    run = ML.train(rows.select("id", "a", "label"), "label", "classification", key="id", features=["a"], num_trees=2, max_depth=2)
    forest = run["model"].stages[-1]
    monkeypatch.setattr(FS, "VOTES", 3)
    assert FS.forest_votes(spark, forest, F.array()) is None and FS.forest_votes(spark, run["model"].stages[0], F.array()) is None
    assert ML.predict_batch(run["model"], rows, ["a"], ["id"]).count() == 4000


@pytest.mark.parametrize("kind, target", [("classification", "label"), ("regression", "y")])
def test_batches_are_scored_a_cell_at_a_time(spark, rows, kind, target):
    run = ML.train(rows.select("id", "a", target), target, kind, key="id", features=["a"], num_trees=3, max_depth=3)
    plan = ML.predict_batch(run["model"], rows, run["features"], ["id"], kind)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange" not in plan


def test_a_loaded_model_is_scored_a_cell_at_a_time(spark, rows, tmp_path):
    run = ML.train(rows.select("id", "a", "label"), "label", "classification", key="id", features=["a"], num_trees=3, max_depth=3)
    model = ML.load_model(ML.save_model(run["model"], str(tmp_path / "m")))
    x = ML.align_features(rows, run["features"], keep=["id"])
    got = ML.classify(model, x).select("id", "prediction")
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ML.predict_batch(run["model"], rows, run["features"], ["id"]).collect()))
