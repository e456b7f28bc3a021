"""Paging, search and row transforms."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import frame_ops as FO
from tessera.operators import profile as P
from tests.helpers import rows

SF = "/root/testdata/sf0.01"


def test_keyset_pages_equal_offset_pages(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    after = None
    for page in range(1, 4):
        a = FO.preview_page(o, ["o_orderkey"], page=page, limit=40)
        b = FO.keyset_page(o, "o_orderkey", after=after, limit=40)
        assert rows(a) == rows(b)
        after = b.agg(F.max("o_orderkey")).first()[0]


def test_page_limits_raise(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    for page, limit in ((0, 10), (1, 0), (1, 1000)):
        with pytest.raises(ValueError):
            FO.preview_page(o, ["o_orderkey"], page=page, limit=limit)
    with pytest.raises(ValueError):
        FO.keyset_page(o, "o_orderkey", limit=501)
    assert FO.preview_page(o, ["o_orderkey"], limit=1000, max_limit=None).count() == 1000


def test_preview_has_headers_and_total(spark):
    df = spark.createDataFrame([(2, None), (1, "x"), (3, "y")], "id int, s string")
    r = FO.preview(df, ["id"], page=1, limit=2).first()
    assert r["headers"] == ["id", "s"] and r["total"] == 3 and list(r["rows"]) == ['{"id":1,"s":"x"}', '{"id":2,"s":null}']
    empty = FO.preview(df.limit(0), ["id"]).first()
    assert empty["total"] == 0 and list(empty["rows"]) == []


def test_row_search_reads_numbers_plainly(spark):
    df = spark.createDataFrame([(1, 12345678.9), (2, 0.5), (3, 1e7), (4, None)], "id int, x double")
    assert [r["id"] for r in FO.row_search(df, "12345678.9").collect()] == [1]
    assert [r["id"] for r in FO.row_search(df, "10000000").collect()] == [3]
    assert [r["id"] for r in FO.row_search(df, "e7").collect()] == []


def test_row_search_ignores_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "Null value"), (3, "x")], "id int, s string")
    assert sorted(r["id"] for r in FO.row_search(df, "null").collect()) == [2]


def test_numeric_coerce(spark):
    df = spark.createDataFrame([("12.5",), ("",), ("abc",), (" 7 ",), ("1d",), ("2f",), ("1e3",)], "raw string")
    got = {r["raw"]: (r["as_number"], r["as_text"]) for r in FO.numeric_coerce(df, "raw").collect()}
    assert got == {"12.5": (12.5, None), "": (0.0, None), "abc": (None, "abc"), " 7 ": (7.0, None),
                   "1d": (None, "1d"), "2f": (None, "2f"), "1e3": (1000.0, None)}


def test_approx_profile_close_to_exact(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    ex = {r["column_name"]: r for r in P.profile_numeric_stats(li, ["l_extendedprice", "l_quantity"]).collect()}
    ap = {r["column_name"]: r for r in P.profile_numeric_stats(li, ["l_extendedprice", "l_quantity"], approx=True).collect()}
    for c in ex:
        span = ex[c]["max"] - ex[c]["min"]
        for k in ("p25", "p50", "p75"):
            assert abs(ex[c][k] - ap[c][k]) <= 0.01 * span
