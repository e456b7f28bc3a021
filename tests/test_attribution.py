"""Attributions against all feature subsets, and against the model's own predictions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution as AT
from tessera.operators import ml as ML


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(500):
        a, b, c, kind = rng.random(), rng.randint(0, 4), rng.gauss(0, 1), rng.choice(["x", "y", "z"])
        out.append((i, a, b, c, kind, rng.random(), "yes" if a + 0.2 * b + (kind == "y") + 0.3 * c > 1 else "no", 3 * a - b + (2.0 if kind == "z" else 0)))
    return spark.createDataFrame(out, "id long, a double, b int, c double, kind string, d double, label string, y double")


def expected(nodes, x, known, value, cover, at=0):
    """The tree's expectation when only the features in ``known`` are."""
    n = nodes[at]
    if n["left"] < 0:
        return value(n["stats"])
    if n["feature"] in known:
        left = (x[n["feature"]] in n["at"]) if n["levels"] >= 0 else x[n["feature"]] <= n["at"][0]
        return expected(nodes, x, known, value, cover, n["left"] if left else n["right"])
    return sum(expected(nodes, x, known, value, cover, c) * cover(nodes[c]["stats"]) for c in (n["left"], n["right"])) / cover(n["stats"])


def brute(trees, x, value, cover):
    m = len(x)
    worth = {}
    for r in range(m + 1):
        for s in itertools.combinations(range(m), r):
            worth[s] = np.mean([expected(t, x, s, value, cover) for t in trees.values()])
    return [sum(math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m)
                * (worth[tuple(sorted((*s, i)))] - worth[s]) for s in worth if i not in s) for i in range(m)], worth[()]


def fitted(rows, kind, target, **kw):
    features = ["a", "b", "c", "kind", "d"]
    run = ML.train(rows.select("id", *features, target), target, kind, key="id", features=features, **kw)
    enc, _ = ML.one_hot_encode(rows, target=None, features=features, keep=["id"])
    return run, enc


@pytest.mark.parametrize("patterns", [9, 1])
@pytest.mark.parametrize("kind, target", [("classification", "label"), ("regression", "y")])
def test_equals_all_subsets(spark, rows, kind, target, patterns, monkeypatch):
    run, enc = fitted(rows, kind, target, num_trees=3, max_depth=4)
    label = 1 if kind == "classification" else None
    trees = {}
    for r in AT.forest_nodes(spark, run["model"].stages[-1]).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    value, cover = ((lambda s: s[1] / sum(s)), sum) if label else ((lambda s: s[1] / s[0]), lambda s: s[0])
    monkeypatch.setattr(AT, "PATTERNS", patterns)
    groups, base = AT.forest_leaves(spark, run["model"].stages[-1], label)
    x = np.array([[r[f] for f in run["features"]] for r in enc.limit(12).collect()])
    got = AT.attribute(x, groups)
    for i in range(len(x)):
        want, empty = brute(trees, x[i], value, cover)
        assert np.allclose(got[i], want, atol=1e-12) and abs(base - empty) < 1e-12


@pytest.mark.parametrize("kind, target", [("classification", "label"), ("regression", "y")])
def test_adds_up_to_the_prediction(spark, rows, kind, target):
    run, enc = fitted(rows, kind, target, num_trees=20, max_depth=8)
    got = AT.attributions(run["model"], enc, run["features"], ["id"])
    assert got.columns == ["id", "base", "prediction", "feature", "value", "attribution"]
    if kind == "classification":
        proba = ML.predict_proba(run["model"], enc, run["features"], keep=["id"]).filter("class = 'yes'").collect()
        model = {r["id"]: r["probability"] for r in proba}
    else:
        model = {r["id"]: r["prediction"] for r in ML.predict_batch(run["model"], enc, run["features"], ["id"], kind).collect()}
    total, base = {}, None
    for r in got.collect():
        total[r["id"]] = total.get(r["id"], 0.0) + r["attribution"]
        base = r["base"]
        assert abs(r["prediction"] - model[r["id"]]) < 1e-9
    assert len(total) == 500 and all(abs(base + total[i] - model[i]) < 1e-9 for i in total)
    summary = {r["feature"]: r["mean_abs"] for r in AT.attribution_summary(got).collect()}
    assert summary["a"] > summary["d"] and set(summary) == set(run["features"])


def test_other_label_and_awkward_input(spark, rows):
    run, enc = fitted(rows, "classification", "label", num_trees=5, max_depth=3)
    yes = {(r["id"], r["feature"]): r["attribution"] for r in AT.attributions(run["model"], enc, run["features"], ["id"], "yes").collect()}
    no = {(r["id"], r["feature"]): r["attribution"] for r in AT.attributions(run["model"], enc, run["features"], ["id"], "no").collect()}
    assert all(abs(yes[k] + no[k]) < 1e-12 for k in yes)
    # a kept column named as a feature, a missing feature, nulls, no rows
    part = enc.drop("c").withColumn("b", enc["b"] * 0 + enc["id"])
    got = AT.attributions(run["model"], part, run["features"], ["b"])
    assert got.columns[0] == "b" and got.filter("feature = 'c'").agg({"value": "max"}).first()[0] == 0.0
    assert AT.attributions(run["model"], enc.limit(0), run["features"], ["id"]).count() == 0


def test_rows_of_a_cell_share_their_attributions(spark, rows):
    run, enc = fitted(rows, "classification", "label", num_trees=5, max_depth=3)
    groups, base = AT.forest_leaves(spark, run["model"].stages[-1], 1)
    edges = AT.forest_cells(groups, len(run["features"]))
    rng = np.random.default_rng(1)
    x = np.array([[rng.choice([*e, e[-1] + 1, rng.normal(), np.inf, np.nan]) for e in edges] for _ in range(3000)])
    each = {}
    for key, a in zip((c.tobytes() for c in AT.cell_of(x, edges)), AT.attribute(x, groups)):
        assert np.array_equal(each.setdefault(key, a), a)
    # 500 distinct rows written four times, and values that no interval holds
    odd = enc.select("id", *[(F.when(F.col("id") % 50 == 7, float("nan")).otherwise(F.col(f)) if f == "a" else F.col(f)).alias(f) for f in run["features"]])
    odd = odd.unionByName(odd).unionByName(odd).unionByName(odd)
    got = {}
    for r in AT.attributions(run["model"], odd, run["features"], ["id"]).collect():
        got.setdefault((r["id"], r["feature"]), []).append(r["attribution"])
    want = {r["id"]: AT.attribute(np.array([[r[f] for f in run["features"]]]), groups)[0] for r in odd.distinct().collect()}
    assert len(got) == 500 * len(run["features"])
    for (i, f), found in got.items():
        assert found == [want[i][run["features"].index(f)]] * 4
