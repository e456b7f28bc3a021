"""Readers, load_table dispatch, catalog and stream-source validation."""

import pytest
from pyspark.sql import types as T

from tessera.sources.files import load_table, read_csv, read_json
from tessera.streaming.streams import register_stream_source


def test_read_csv_na_strings(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b,c\n1,x,2.5\nNA,null,\nn/a,y,NaN\n3,N/A,4\n")
    inferred = read_csv(spark, str(p))
    assert inferred.count() == 4
    assert inferred.filter("b IS NULL").count() == 2
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()),
                           T.StructField("c", T.DoubleType())])
    pinned = read_csv(spark, str(p), schema=schema)
    assert pinned.filter("a IS NULL").count() == 2
    assert pinned.filter("c IS NULL").count() == 2


def test_read_json_multiline_array(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    df = read_json(spark, str(p), multiline=True)
    assert df.count() == 2 and df.filter("b IS NULL").count() == 1


def test_load_table_dispatch(spark, tmp_path):
    p = tmp_path / "t.CSV"
    p.write_text("a\n1\n")
    assert load_table(spark, str(p)).count() == 1
    assert load_table(spark, "/root/testdata/sf0.001/region.parquet").count() == 5
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "x.xlsx"))
    with pytest.raises(ValueError):
        load_table(spark, "x", source_type="ftp")


def test_stream_source_validation():
    assert register_stream_source("s", "kafka")["status"] == "registered"
    assert register_stream_source("s", "IoT")["status"] == "registered"
    assert register_stream_source("s", "web_logs")["status"] == "registered"
    assert register_stream_source("s", "mqtt")["status"] == "rejected"


def test_catalog_register_list_export(spark, tmp_path):
    import json
    import os

    from tessera.sources import catalog as C
    sf = "/root/testdata/sf0.001"
    cat = str(tmp_path / "cat")
    C.register_datasets(spark, cat, [(t, "parquet", f"{sf}/{t}.parquet", spark.read.parquet(f"{sf}/{t}.parquet"))
                                     for t in ("nation", "region")])
    C.register_datasets(spark, cat, [("orders", "parquet", f"{sf}/orders.parquet", spark.read.parquet(f"{sf}/orders.parquet"))])
    rows = C.list_datasets(spark, cat).collect()
    assert [r["name"] for r in rows][0] == "orders"           # newest first
    got = {r["name"]: r for r in rows}
    assert got["nation"]["rows"] == 25 and got["nation"]["columns"] == 3
    assert got["orders"]["size_bytes"] == os.path.getsize(f"{sf}/orders.parquet")
    C.register_datasets(spark, cat, [("region", "parquet", None, spark.read.parquet(f"{sf}/region.parquet"))], {"region": '{"a": 1}'})
    assert C.list_datasets(spark, cat).count() == 3                # registered twice: the latest counts
    assert json.loads(C.export_dataset(spark, cat, "region").first()["document"])["profile"] == {"a": 1}
    doc = json.loads(C.export_dataset(spark, cat, "region").first()["document"])
    assert doc["rows"] == 5 and doc["schema"]["fields"][0]["name"] == "r_regionkey"


def test_checkpoint_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from tessera.session import _ensure_checkpoint_dir
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            _ensure_checkpoint_dir(fake)


def test_inferred_types_with_na_spellings(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b,c,d,e,f\n1,2.5,true,2024-01-02,x,\nNA,N/A,null,NaN,"two\nlines, ""q""",\n3,4,False,2024-01-03 10:00:00,1d,\n')
    df = read_csv(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "timestamp_ntz", "string", "string"]
    got = df.collect()
    assert [r["a"] for r in got] == [1, None, 3] and [r["b"] for r in got] == [2.5, None, 4.0]
    assert [r["e"] for r in got] == ["x", 'two\nlines, "q"', "1d"] and [r["f"] for r in got] == [None] * 3


def test_json_array_through_load_table(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('[\n  {"a": 1,\n   "b": "x"},\n  {"a": 2, "b": null}\n]\n')
    df = load_table(spark, str(p))
    assert df.columns == ["a", "b"] and sorted(r["a"] for r in df.collect()) == [1, 2]
    q = tmp_path / "l.json"
    q.write_text('{"a": 1}\n{"a": 2}\n')
    assert load_table(spark, str(q)).count() == 2
