"""The pipeline against its stages written plainly, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tessera.llm import decontamination, line_quality
from tessera.llm.common import cut, table
from tests.llm.util import DOCS, documents, with_clashes
from tools.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "pack"]
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), "t")
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    whole = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    judged = {d: line_quality.judge(t) for d, t in whole.items()}
    assert sorted(kept["quality"]) == sorted((d, j["clean_text"]) for d, j in judged.items() if j["kept"])
    one = dict(kept["near_duplicates"])
    assert set(one) <= set(dict(kept["quality"])) and len(one) == len(kept["near_duplicates"]) < len(kept["quality"])
    items = [(r.item_id, decontamination.normal(r.text)) for r in table(spark, SF, "benchmark").collect()]
    find = decontamination.Matcher(items, decontamination.RATE).find
    assert {d for d, _ in kept["decontaminate"]} == {d for d, t in one.items() if not find(t)}
    assert {d for d, _ in kept["mix"]} <= {d for d, _ in kept["decontaminate"]}
    out = pipeline.run(spark, SF)
    assert sorted(out.columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _ in kept["mix"])


def test_awkward_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns; an empty table."""
    odd = ("_size", "_key", "_row", "_source", "kept", "clean_text", "_doc", "copies", "row")
    docs = with_clashes(documents(spark, DOCS + [(20, DOCS[0][1], None, "a", 1), (21, DOCS[0][1] + " And one more.", "en", None, 1)]), *odd)
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), "t")
        assert docs.columns == columns, name
        rows = docs.collect()
        assert all(r[c] == c for r in rows for c in odd), name
        if name == "quality":
            assert all(line_quality.judge(t)["kept"] == any(r.doc_id == d for r in rows) for d, t, *_ in DOCS if d is not None)
        if name == "near_duplicates":
            assert len({r.text for r in rows}) == len(rows) and rows
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    none = documents(spark, [])
    for _, stage in pipeline.STAGES:
        none_next = stage(spark, none, SF)
        assert none_next.count() == 0


def test_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    con = connect(SF)
    for name in ("op1_line_quality", "op2_chat_windows", "op5_warc_revisits", "op8_mix_sources", "op11_main_text",
                 "op12_stratified_search", "op13_hard_negatives"):
        assert compare(entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()) is None, name
