"""Forests grown on cells against forests grown on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution as AT
from tessera.operators import forest_cells as FC
from tessera.operators import ml as ML


@pytest.fixture(scope="module")
def rows(spark):
    h = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 for i in range(4)]
    kind = F.element_at(F.array(*[F.lit(k) for k in "xyz"]), (h[2] * 3).cast("int") + 1)
    y = 10 * h[0] + F.when(kind == "z", 4.0).otherwise(0.0) + h[3]
    d = spark.range(6000).select("id", h[0].alias("a"), F.floor(h[1] * 5).alias("b"), kind.alias("kind"), y.alias("y"))
    return d.withColumn("label", F.when(F.col("y") > 6, "yes").otherwise("no"))


@pytest.mark.parametrize("kind, target, group", [("classification", "label", 1000), ("regression", "y", 1000), ("regression", "y", 5)])
def test_grown_on_cells_as_on_rows(spark, rows, kind, target, group, monkeypatch):
    features, grown = ["a", "b", "kind"], []

    def train():
        return ML.train(rows.select("id", *features, target), target, kind, key="id", features=features, num_trees=20, max_depth=6)
    whole = train()
    monkeypatch.setattr(FC, "ROWS", 0)
    monkeypatch.setattr(FC, "GROUP", group)
    joined = FC._joined
    monkeypatch.setattr(FC, "_joined", lambda *a: grown.append(1) or joined(*a))
    cells, again = train(), train()
    assert len(grown) == 2 and cells["features"] == whole["features"]
    for k, v in whole["metrics"].items():
        assert cells["metrics"][k] == pytest.approx(v, rel=0.1, abs=0.02) and again["metrics"][k] == pytest.approx(cells["metrics"][k], rel=1e-9)
    forest, plain = cells["model"].stages[-1], whole["model"].stages[-1]
    assert forest.getNumTrees == 20 and forest.numFeatures == plain.numFeatures
    assert np.allclose(forest.featureImportances.toArray(), plain.featureImportances.toArray(), atol=0.05)
    # as many rows to each tree as the bootstrap draws, thresholds between values
    train_rows = rows.withColumn("s", ML.split_column("id")).filter("s = 'train'").count()
    nodes = AT.forest_nodes(spark, forest).collect()
    for r in (r for r in nodes if r["id"] == 0):
        drawn = sum(r["stats"]) if kind == "classification" else r["stats"][0]
        assert abs(drawn - train_rows) < 6 * train_rows ** 0.5
    cuts = {r["at"][0] for r in nodes if r["left"] >= 0 and cells["features"][r["feature"]] == "a"}
    assert len(cuts) > 3 and all(0 < c < 1 for c in cuts)
    assert {r["at"][0] for r in nodes if r["left"] >= 0 and cells["features"][r["feature"]] == "b"} <= {0.5, 1.5, 2.5, 3.5, 1.0, 2.0, 3.0}


def test_drawn_sums_are_those_of_a_bootstrap(spark):
    rows = spark.range(3000).select(F.encode(F.lit("c"), "utf-8").alias("cell"), (F.col("id") % 10).cast("double").alias("y"))
    s = np.array(FC._drawn_values(rows, 400, 1, 1).first()["s"]).reshape(3, 400)
    assert abs(s[0].mean() - 3000) < 15 and 2300 < s[0].var() < 3800      # Poisson(3000)
    assert abs((s[1] / s[0]).mean() - 4.5) < 0.02 and abs((s[2] / s[0]).mean() - 28.5) < 0.2
    n = spark.createDataFrame([(bytearray(b"c"), 1.0, 3000)], "cell binary, y double, n long")
    c = np.array(FC._drawn_classes(n, 400, 1).first()["s"])
    assert abs(c.mean() - 3000) < 15 and 2300 < c.var() < 3800


def test_rows_that_share_no_cells_are_grown_as_rows(spark, rows, monkeypatch):
    vec, _ = ML.one_hot_vector(rows, "y", ["a", "b", "kind"])
    args = ("y", None, {"featuresCol": "_features", "predictionCol": "prediction"}, 2, 2, 1, 64)
    assert FC.fit_on_cells(vec, *args) is None
    monkeypatch.setattr(FC, "ROWS", 0)
    monkeypatch.setattr(FC, "CELLS", 10)
    assert FC.fit_on_cells(vec, *args) is None


def test_edges_as_mllib_places_them():
    assert FC.feature_edges(np.array([1.0, 1.0, 3.0])).tolist() == [2.0] and len(FC.feature_edges(np.ones(5))) == 0
    e = FC.feature_edges(np.arange(10000.0))
    assert len(e) == 31 and np.allclose(np.diff(e), 312.5, atol=1)


def test_a_fit_has_no_more_tasks_than_its_input_asks_for(spark, tmp_path):
    from tessera.functions.exprs import spread
    path = str(tmp_path / "rows")
    spark.range(1000).repartition(1).write.parquet(path)
    rows = spark.read.parquet(path)
    asked, most = spark.conf.get("spark.sql.shuffle.partitions"), 2 * spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(10 * most))
    try:
        assert spread(rows, ["id"], 1 << 20).rdd.getNumPartitions() == most
        assert spread(rows, ["id"], 1).rdd.getNumPartitions() == 10 * most      # never more than without
        assert spread(rows, ["id"]).rdd.getNumPartitions() == 10 * most
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)


@pytest.mark.parametrize("classes", [3, None])
def test_a_tree_is_the_one_mllib_grows(spark, classes):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    rng = np.random.default_rng(4)
    codes = rng.integers(0, [8, 5, 2, 1], (1500, 4))
    y = (codes[:, 0] * 3 + codes[:, 1] * codes[:, 2] + rng.integers(0, 6, 1500)) % 7
    y = y % 3 if classes else y * 1.5
    df = spark.createDataFrame([(*map(float, c), float(v)) for c, v in zip(codes, y)], "a double, b double, c double, d double, y double")
    kind = RandomForestClassifier if classes else RandomForestRegressor
    mllib = kind(featuresCol="x", labelCol="y", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=5, seed=1).fit(
        VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="x").transform(df))
    want = {r["id"]: r for r in AT.forest_nodes(spark, mllib).collect()}
    stats = np.eye(3)[y].T if classes else np.stack([np.ones(1500), y, y * y])
    for mb in (256, 0):       # side by side, or a node at a time
        t = FC.grow_tree(codes.T.astype(np.uint8), stats, [8, 5, 2, 1], bool(classes), 5, 4, rng, mb)

        def same(mine, theirs):
            r = want[theirs]
            assert np.allclose(t["impurityStats"][mine], r["stats"]) and (t["leftChild"][mine] < 0) == (r["left"] < 0)
            if r["left"] < 0:
                return 1
            assert t["feature"][mine] == r["feature"] and t["bin"][mine] + 0.5 == r["at"][0]
            return 1 + same(t["leftChild"][mine], r["left"]) + same(t["rightChild"][mine], r["right"])
        assert same(0, 0) == len(want) == len(t["id"]) > 15


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark, rows, monkeypatch):
    monkeypatch.setattr(FC, "ROWS", 0)
    vec, _ = ML.one_hot_vector(rows, "y", ["a", "b", "kind"])
    jobs = []
    for trees in (3, 12):
        spark.sparkContext.setJobGroup(f"fit-{trees}", "")
        FC.fit_on_cells(vec, "y", None, {"featuresCol": "_features", "predictionCol": "prediction"}, trees, 4, 1, 64)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[0] - jobs[1]) <= 2      # before: a fit of its own for each tree
