"""Operator 8 against the same method written plainly."""

import hashlib
import math

from tessera.llm import mixing as op
from tests.llm.util import DOCS, documents, with_clashes


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Reshare what is above by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        weight = sum(w[s] for s in free)
        t = {s: (goal - sum(stopped.values())) * w[s] / weight for s in free} if weight else {}
        over = [s for s in free if t[s] > most * sizes[s] + 1e-9]
        if not over:
            return t | stopped
        stopped |= {s: most * sizes[s] for s in over}


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 60, None: 7, "B": 900}, {"x": 10}, {"a": 0, "b": 0}, {"a": 1, "b": 1000, "c": 3, "d": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in op.targets(df).collect()}
        want = plain_targets(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes), (got, want)


def test_systematic_sampling(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), "", "s%d" % (i % 3 if i % 5 else 0), 0) for i in range(600)]
    rows += [(1000 + i, "same text", "", "s0", 0) for i in range(400)]        # a large group of copies
    docs = documents(spark, rows)
    got = op.plan_mix(op._marks(docs, "doc_id", "source", op.word_count(op.F.col("text")), "text")).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    goal = plain_targets(sizes)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    for s, rs in by_source.items():
        units = min(math.floor(goal[s] / sizes[s] * op.UNIT), 2 * op.UNIT)
        end = int(hashlib.md5(f"{op.SEED}:{s}".encode()).hexdigest()[:6], 16)
        for r in sorted(rs, key=lambda r: (r._size, hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
            assert r._copies == (end + units) // op.UNIT - end // op.UNIT and r._copies <= 2
            end += units
        taken = sum(r._copies * r._size for r in rs)
        assert abs(taken - goal[s]) <= 2 * max(r._size for r in rs)
    emitted = [r.doc_id for r in op.mix(docs).collect()]
    assert sorted(emitted) == sorted(r.doc_id for r in got for _ in range(r._copies))
    assert sorted(emitted) == sorted(r.doc_id for r in op.mix(docs.repartition(7)).collect())


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark), "size", "target", "copies", "_size", "_key", "_row", "_source", "_doc", "_copies")
    out = op.mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in DOCS}
    assert op.mix(documents(spark, [])).count() == 0


def _plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_whole_rows_move_once(spark, tmp_path):
    import re
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, f"s{i % 3}", "a b c") for i in range(60)], "doc_id long, source string, text string").write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(op.mix(spark.read.parquet(path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [cols for cols in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]", plan) if "_doc" in cols]
    assert len(moved) == 1


def test_repeated_rows_share_their_copies(spark):
    """Rows of one id, source and text with other columns apart: each has the copies of a row of its own."""
    rows = [(1, "a", "x y", i) for i in range(4)] + [(None, None, None, 9), (2, "a", "z z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, extra int")
    got = [r["extra"] for r in op.mix(docs, share=2.0, most=2).collect()]
    assert {e: got.count(e) for e in got} == {0: 2, 1: 2, 2: 2, 3: 2, 5: 2}
