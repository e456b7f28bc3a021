"""Operator 5: URLs, validators, headers and the as-of rule."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.llm import revisits as op

SCHEMA = "record_id long, warc_type string, target_uri string, warc_date timestamp, status int, headers map<string,string>, body string"


def at(day, second=0):
    return dt.datetime(2024, 1, day, 0, 0, second)


def test_canonical_url(spark):
    same = [["http://www.Example.com:80/a/?b=2&a=1#x", "HTTPS://example.com/a?a=1&utm_source=q&b=2"], ["example.com", "http://example.com/"]]
    for group in same:
        df = spark.createDataFrame([(u,) for u in group], "u string").select(op.canonical_url(F.col("u")).alias("k"))
        assert len({r.k for r in df.collect()}) == 1


def test_rules(spark):
    u = "http://e.com/x"
    rows = [
        (1, "response", u, at(1), 200, {"ETag": '"a"', "Content-Type": "text/html", "Vary": "old"}, "one"),
        (2, "response", u, at(3), 200, {"ETag": '"b"', "Last-Modified": "m"}, "two"),
        (3, "response", u, at(4), 404, {}, "none"),
        (4, "revisit", u + "#z", at(2), 304, {"etag": 'W/"a"', "Content-Type": "no", "vary": "new", "X-New": "1"}, None),
        (5, "revisit", "https://e.com/x/", at(5), 304, {"etag": '"a"'}, None),
        (6, "revisit", u, at(5), 304, {"last-modified": "m"}, None),
        (7, "revisit", u, at(5), 304, None, None),
        (8, "revisit", u, at(1), 304, {"etag": '"a"'}, None),          # not strictly earlier
        (9, "revisit", None, at(9), 304, {}, None),
        (10, "revisit", u, None, 304, {}, None),
        (11, "response", "http://e.com/t", at(1), 200, {"etag": '"1"'}, "a"),
        (12, "response", "http://e.com/t", at(1), 200, {"etag": '"2"'}, "b"),
        (13, "revisit", "http://e.com/t", at(1, 1), 304, {"ETag": '"2"'}, None),
        (13, "revisit", "http://e.com/t", at(1, 1), 304, {"ETag": '"2"'}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.lit("x")).withColumn("best", F.lit(1))
    got = op.resolve(df)
    r = {x.record_id: x for x in got.collect()}
    assert got.count() == 9
    assert r[4].verdict == "resolved" and r[4].original_id == 1
    assert r[4].headers == {"etag": 'W/"a"', "content-type": "text/html", "vary": "new", "x-new": "1"}
    assert r[5].verdict == "validator_mismatch" and r[5].original_id is None and r[5].headers is None
    assert (r[6].verdict, r[6].original_id) == ("resolved", 2) and (r[7].verdict, r[7].original_id) == ("unvalidated", 2)
    assert r[8].verdict == r[9].verdict == r[10].verdict == "no_original"
    assert (r[13].verdict, r[13].original_id) == ("resolved", 12)
    bodies = {x.record_id: x.body for x in op.with_bodies(got, df).collect()}
    assert bodies[4] == "one" and bodies[13] == "b" and bodies[5] is None
    assert op.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_url_equals_plain_as_of(spark):
    u = "http://e.com/hot"
    rows = [(i, "response" if i % 3 else "revisit", u, at(1 + i * 7 % 20, i % 5), 200 if i % 3 else 304, {"etag": '"t"'}, None) for i in range(900)]
    got = {r.record_id: r.original_id for r in op.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    full = [(r[3], r[0]) for r in rows if r[1] == "response"]
    for r in rows:
        if r[1] == "revisit":
            before = [x for x in full if x[0] < r[3]]
            assert got[r[0]] == (max(before)[1] if before else None)


def test_percent_escapes(spark):
    rows = [("http://e.com/a%2fb%c3%a9?q=%3d&p=%zz", "e.com/a%2Fb%C3%A9?p=%zz&q=%3D"), ("e.com/100%", "e.com/100%"), ("e.com/%", "e.com/%")]
    got = spark.createDataFrame(rows, "u string, k string").select(op.canonical_url(F.col("u")).alias("got"), "k").collect()
    assert [r.got for r in got] == [r.k for r in got]
    records = [(1, "response", "http://e.com/a%2Fb", at(1), 200, {"etag": '"a"'}, "x"), (2, "revisit", "http://e.com/a%2fb", at(2), 304, {}, None)]
    assert op.resolve(spark.createDataFrame(records, SCHEMA)).collect()[0].original_id == 1


def test_fractions_of_a_second(spark):
    u, micros = "http://e.com/x", lambda n: at(2) + dt.timedelta(microseconds=n)
    rows = [(1, "response", u, at(1), 200, {}, "old"), (2, "response", u, micros(100_000), 200, {}, "new"),
            (3, "revisit", u, micros(700_000), 304, {}, None), (4, "revisit", u, micros(100_000), 304, {}, None)]
    got = {r.record_id: r.original_id for r in op.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {3: 2, 4: 1}
