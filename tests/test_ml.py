"""ML lifecycle: encoding against pandas, split fractions, training errors,
feature alignment and distributed permutation."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import ml as ML


def test_one_hot_matches_get_dummies(spark):
    data = [(1, "b", 2.0, "x"), (2, "a", None, "y"), (3, None, 1.5, "x"), (4, "c", 3.0, "z"), (5, "a", 1.0, "y")]
    df = spark.createDataFrame(data, "k long, cat string, num double, t string")
    enc, names = ML.one_hot_encode(df, target="t")
    pdf = pd.DataFrame(data, columns=["k", "cat", "num", "t"])
    ref = pd.get_dummies(pdf.drop(columns=["t"]), drop_first=True).fillna(0).astype(float)
    assert names == list(ref.columns)
    got = enc.toPandas().sort_values("k")[names].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, ref.reset_index(drop=True), check_dtype=False)


def test_one_hot_is_exact_at_any_number_of_levels(spark):
    df = spark.createDataFrame([(i, f"v{i:04d}" if i < 1001 else None) for i in range(1002)], "k long, s string")
    with pytest.raises(ValueError, match="1001 levels"):
        ML.one_hot_encode(df, features=["s"], max_levels=1000)
    vec, names = ML.one_hot_vector(df, features=["s"], keep=["k"])
    assert sorted(names) == [f"s_v{i:04d}" for i in range(1, 1001)]
    for r in vec.filter("k IN (0, 1, 700, 1001)").collect():
        on = [names[i] for i in r["_features"].indices]
        assert on == ([] if r["k"] in (0, 1001) else [f"s_v{r['k']:04d}"])
    few, wide = ML.one_hot_encode(df.filter("k < 40"), features=["s"])
    assert wide == [f"s_v{i:04d}" for i in range(1, 40)] and few.count() == 40


def test_vector_equals_wide_form(spark):
    rows = [(1, "b", 2.0, True), (2, "a", None, False), (3, None, 1.5, None), (4, "c", 3.0, True), (5, "a", 1.0, False)]
    df = spark.createDataFrame(rows, "k long, cat string, num double, flag boolean").withColumn("none", F.lit(None).cast("string"))
    wide, w_names = ML.one_hot_encode(df, features=["cat", "num", "flag", "none"], keep=["k"])
    vec, v_names = ML.one_hot_vector(df, features=["cat", "num", "flag", "none"], keep=["k"])
    assert sorted(w_names) == sorted(v_names)
    want = {r["k"]: {n: r[n] for n in w_names} for r in wide.collect()}
    assert {r["k"]: dict(zip(v_names, r["_features"].toArray())) for r in vec.collect()} == want


def test_unseen_and_null_labels(spark):
    train = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 2)) for i in range(40)], "k long, y string, x double")
    vec, names = ML.one_hot_vector(train, "y", ["x"], keep=["k"])
    model = ML.fit_forest(vec, names, "y", "classification", vec, num_trees=5, max_depth=3)
    test = spark.createDataFrame([(1, "a", 1.0), (2, "b", 0.0), (3, "c", 1.0), (4, "d", 0.0)], "k long, y string, x double")
    got = ML.evaluate_classifier(model, test)
    assert got["accuracy"] == 0.5 and got["f1"] < 0.5
    with pytest.raises(ValueError, match="null"):
        ML.evaluate_classifier(model, test.withColumn("y", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="null"):
        ML.train(train.withColumn("y", F.when(F.col("k") > 3, F.col("y"))), "y", "classification", key="k", num_trees=2, max_depth=2)


def test_cross_validation_grows_the_trained_forest():
    import inspect
    t, c = inspect.signature(ML.train).parameters, inspect.signature(ML.cross_validate).parameters
    assert t["num_trees"].default == c["num_trees"].default and t["max_depth"].default == c["max_depth"].default == 30


def test_split_fraction_and_stability(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    s = df.withColumn("sp", ML.split_column("k", 0.2))
    frac = s.filter("sp = 'test'").count() / 20000
    assert 0.18 < frac < 0.22
    a = sorted(r[0] for r in s.repartition(7).filter("sp = 'test'").select("k").collect())
    b = sorted(r[0] for r in df.repartition(3).withColumn("sp", ML.split_column("k", 0.2)).filter("sp = 'test'").select("k").collect())
    assert a == b


def test_missing_target_raises_before_any_job(spark):
    df = spark.createDataFrame([(1, 2.0)], "a long, b double")
    with pytest.raises(ValueError, match="Target column not found"):
        ML.train(df, "nope", "classification")


def test_align_features_missing_zero_extra_ignored(spark):
    df = spark.createDataFrame([(1, 5.0, 9.0)], "k long, a double, extra double")
    x = ML.align_features(df, ["a", "b"], keep=["k"])
    assert x.columns == ["k", "a", "b"] and x.first()["b"] == 0.0


def test_train_predict_roundtrip(spark, tmp_path):
    rows = [(i, "hi" if i % 3 else "lo", float(i % 7), "p" if i % 2 else "q") for i in range(300)]
    df = spark.createDataFrame(rows, "k long, label string, x double, c string")
    run = ML.train(df, "label", "classification", key="k", num_trees=10, max_depth=4)
    assert 0.0 <= run["metric_value"] <= 1.0 and run["metric_name"] == "accuracy"
    path = ML.save_model(run["model"], str(tmp_path / "m"))
    model = ML.load_model(path)
    enc, _ = ML.one_hot_encode(df, target="label", keep=["k"])
    pred = ML.predict_batch(model, enc.drop("label"), run["features"], keep=["k"])
    assert set(r[0] for r in pred.select("prediction").distinct().collect()) <= {"hi", "lo"}
    proba = ML.predict_proba(model, enc.drop("label"), run["features"], keep=["k"])
    sums = proba.groupBy("k").agg(F.sum("probability").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)
    imp = ML.feature_importance(spark, run["model"], run["features"]).collect()
    assert sum(r["importance"] for r in imp) == pytest.approx(1.0)


def test_permute_column_keeps_multiset(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    p = ML.permute_column(df, "v", ["k"], block_rows=1000)
    assert p.count() == 5000
    assert sorted(r[0] for r in p.select("v").collect()) == [i * 3 for i in range(5000)]
    moved = p.filter(F.col("v") != F.col("k") * 3).count()
    assert moved > 4000


@pytest.mark.parametrize("kind, target", [("classification", "label"), ("regression", "y")])
def test_permutation_importance_scores_cells(spark, kind, target, monkeypatch):
    h = [F.pmod(F.xxhash64("k", F.lit(i)), F.lit(1000)) / 1000 for i in range(2)]
    df = spark.range(25000).select(F.col("id").alias("k"), h[0].alias("a"), h[1].alias("b"), F.when(F.col("id") % 3 == 0, "p").when(F.col("id") % 7 > 0, "q").alias("c"))
    df = df.withColumn("y", 3 * F.col("a") + F.when(F.col("c") == "p", 1.0).otherwise(0.0))
    df = df.withColumn("label", F.when(F.col("y") > 2, "hi").otherwise("lo")).drop("y" if target == "label" else "label")
    run = ML.train(df, target, kind, key="k", num_trees=4, max_depth=4)
    test, _ = ML.one_hot_encode(df, target=target, keep=["k"])

    def metric(d):
        return ML.evaluate_classifier(run["model"], d)["accuracy"] if kind == "classification" else ML.evaluate_regressor(run["model"], d, target)["r2"]
    want = {f: metric(ML.permute_column(test, f, ["k"])) for f in run["features"]}
    base, scored, plain = metric(test), [], ML._score
    monkeypatch.setattr(ML, "_score", lambda m, d: scored.append(d.count()) or plain(m, d))
    got = ML.permutation_importance(spark, run["model"], test, run["features"], ["k"], kind, target).collect()
    assert [r["feature"] for r in got] == run["features"]
    for r in got:
        assert r["baseline"] == pytest.approx(base, abs=1e-9) and r["permuted"] == pytest.approx(want[r["feature"]], abs=1e-9)
    assert max(r["importance"] for r in got) > 0.05
    assert len(scored) == 1 and scored[0] < 25000        # before: every row once a feature and once more


def test_leaderboard_stages(spark):
    import datetime as dt
    rs = []
    for i, (pt, m) in enumerate([("classification", {"accuracy": 0.9, "f1": 0.8}),
                                 ("classification", {"accuracy": 0.7, "f1": 0.6}),
                                 ("regression", {"rmse": 3.0, "r2": 0.5})]):
        rs.append((f"r{i}", f"m{i}", "rf", pt, "t", ["a"], "x", 0.0, m, {}, dt.datetime(2024, 1, 1 + i), None))
    runs = spark.createDataFrame(rs, ML.RUN_SCHEMA)
    lb = {r["model_name"]: r for r in ML.model_leaderboard(runs).collect()}
    assert lb["m1"]["stage"] == "Production" and lb["m0"]["stage"] == "Staging" and lb["m2"]["stage"] == "Production"
    s = ML.registry_summary(runs).first()
    assert s["classifiers"] == 2 and s["mean_accuracy"] == pytest.approx(0.8)
    cmp = {r["metric"]: r for r in ML.model_compare(runs, ["m0", "m2"]).collect()}
    assert cmp["rmse"]["m0"] == "-" and cmp["accuracy"]["m2"] == "-"
