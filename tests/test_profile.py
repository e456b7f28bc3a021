"""Profiling operators against pandas / numpy twins on small frames with
nulls, constants, ties, unicode, one row and zero rows."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import profile as P

SCHEMA = "id long, x double, y double, c double, s string, b boolean"
DATA = [
    (1, 1.0, 2.0, 5.0, "a", True),
    (2, 2.0, None, 5.0, "b", False),
    (3, None, 1.0, 5.0, "a", True),
    (4, 4.0, 8.0, 5.0, None, None),
    (5, 100.0, 3.0, 5.0, "é", True),
    (6, 3.0, 2.5, 5.0, "a", False),
    (7, 2.5, 2.5, 5.0, "b", True),
    (8, float("nan"), 7.0, 5.0, "b", True),
]


@pytest.fixture(scope="module")
def frames(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    pdf = pd.DataFrame(DATA, columns=["id", "x", "y", "c", "s", "b"])
    return df, pdf


def by_col(df, key="column_name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_numeric_stats_match_pandas_describe(frames):
    df, pdf = frames
    got = by_col(P.profile_numeric_stats(df))
    desc = pdf[["id", "x", "y", "c"]].describe()
    for c in ["id", "x", "y", "c"]:
        assert got[c]["count"] == desc[c]["count"]
        assert got[c]["mean"] == pytest.approx(round(desc[c]["mean"], 4))
        assert got[c]["std"] == pytest.approx(round(desc[c]["std"], 4))
        for q, k in [("25%", "p25"), ("50%", "p50"), ("75%", "p75")]:
            assert got[c][k] == pytest.approx(round(desc[c][q], 4))
        assert got[c]["min"] == desc[c]["min"] and got[c]["max"] == desc[c]["max"]


def test_categorical_stats(frames):
    df, pdf = frames
    got = by_col(P.profile_categorical_stats(df, ["s"]))
    assert got["s"]["count"] == pdf["s"].count()
    assert got["s"]["unique"] == pdf["s"].nunique()
    assert got["s"]["top"] in ("a", "b") and got["s"]["freq"] == 3
    # tie between a and b (3 each): smallest value wins
    assert got["s"]["top"] == "a"


def test_missing_counts_nan_as_missing(frames):
    df, pdf = frames
    got = by_col(P.profile_missing(df))
    for c, n in pdf.isna().sum().items():
        assert got[c]["missing"] == n


def test_duplicates_null_equals_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], "k int, v string")
    r = P.profile_duplicates(df).first()
    pdf = pd.DataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a"), (3, "b")], columns=["k", "v"])
    assert r["duplicates"] == pdf.duplicated().sum() == 3
    assert r["rows"] == 6 and r["distinct_rows"] == 3


def test_unique_counts_null_as_value(frames):
    df, pdf = frames
    got = by_col(P.profile_unique(df, ["s", "x", "id"]))
    # pandas nunique(dropna=False) counts NaN once
    assert got["s"]["unique_values"] == pdf["s"].nunique(dropna=False)
    assert got["id"]["unique_values"] == 8
    assert got["x"]["unique_values"] == pdf["x"].nunique(dropna=False)   # None and NaN count once


def test_correlations_pairwise_and_constant_zero(frames):
    df, pdf = frames
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.profile_correlations(df, ["x", "y", "c"]).collect()}
    ref = pdf[["x", "y", "c"]].corr().fillna(0.0)
    for a in ["x", "y", "c"]:
        for b in ["x", "y", "c"]:
            assert got[(a, b)] == pytest.approx(round(ref.loc[a, b], 4), abs=1e-4), (a, b)
    assert got[("c", "c")] == 0.0


def test_outliers_tukey_and_iqr_zero(frames):
    df, pdf = frames
    got = by_col(P.profile_outliers(df, ["x", "y", "c"]))
    for c in ["x", "y", "c"]:
        s = pdf[c]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        iqr = q3 - q1
        exp = 0 if iqr == 0 else int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())
        assert got[c]["outliers"] == exp, c


def test_class_imbalance_null_is_value(frames):
    df, pdf = frames
    got = by_col(P.profile_class_imbalance(df, ["s"]))
    assert got["s"]["imbalance"] == pytest.approx(round(pdf["s"].value_counts(normalize=True, dropna=False).max(), 4))


def test_histogram_matches_numpy(frames):
    df, pdf = frames
    h = P.profile_histogram(df, ["x", "y", "c"]).toPandas()
    for c in ["x", "y", "c"]:
        counts = h[h.column_name == c].sort_values("bin")["count"].tolist()
        ref = np.histogram(pdf[c].dropna(), bins=10)[0].tolist()
        assert counts == ref, c
    # constant column: everything lands in the middle bin
    cc = h[h.column_name == "c"].sort_values("bin")["count"].tolist()
    assert cc[5] == 8 and sum(cc) == 8


def test_histogram_empty_column_is_zeros(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    h = P.profile_histogram(df).orderBy("bin").collect()
    assert [r["count"] for r in h] == [0] * 10


def test_zero_and_one_row(spark):
    empty = spark.createDataFrame([], "a double, s string")
    assert P.profile_missing(empty).filter("missing > 0").count() == 0
    assert P.profile_duplicates(empty).first()["duplicates"] == 0
    one = spark.createDataFrame([(1.0, "x")], "a double, s string")
    r = by_col(P.profile_numeric_stats(one))
    assert r["a"]["count"] == 1 and r["a"]["std"] is None


def test_schema_dtypes(frames):
    df, _ = frames
    got = {r["column_name"]: r["dtype"] for r in P.profile_schema(df).collect()}
    assert got == {"id": "int64", "x": "float64", "y": "float64", "c": "float64", "s": "object", "b": "bool"}


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[2.0, 0.3, 0.1], [0.0, 1.0, 0.5], [0.0, 0.0, 0.2]])
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["id"] = range(200)
    df = spark.createDataFrame(pdf)
    coords, ratio = P.profile_pca(df, ["a", "b", "c"], k=2, id_cols=["id"])
    got = coords.toPandas().sort_values("id")[["pc1", "pc2"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    ref = z @ vt[:2].T
    for j in range(2):
        if vt[j][np.argmax(np.abs(vt[j]))] < 0:
            ref[:, j] *= -1
    assert np.allclose(got, ref, atol=1e-6)
    var = (s ** 2) / (s ** 2).sum()
    assert np.allclose(sorted(r["explained_variance_ratio"] for r in ratio.collect())[::-1], var[:2], atol=1e-6)


def test_pca_needs_two_columns(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    coords, ratio = P.profile_pca(df, ["a"])
    assert coords.count() == 0 and ratio.count() == 0


def test_tables_without_numeric_or_string_columns(spark):
    s_only = spark.createDataFrame([("a",), ("b",)], "s string")
    n_only = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert P.profile_numeric_stats(s_only).count() == 0
    assert P.profile_histogram(s_only).count() == 0
    assert P.profile_outliers(s_only).count() == 0
    assert P.profile_categorical_stats(n_only).count() == 0
    assert P.column_stats_sorted(s_only).count() == 1
    assert P.profile_dataset(s_only).count() > 0
