"""The passage index and ordered funnels against plain loops."""

import datetime as dt
import math
import random
from collections import Counter

import pytest

from tessera.operators import analytics as A
from tessera.operators import passage_index as PI


def bm25(passages, queries, k):
    words = {key: [w for w in text.lower().split(" ") if w] for *key, text in ((a, b, c) for a, b, c in passages if c)
             for key in [tuple(key)]}
    words = {key: w for key, w in words.items() if w}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words))
    df = Counter(t for w in words.values() for t in set(w))
    out = []
    for q, text in queries:
        times = Counter(w for w in (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ") if w)
        scores = Counter()
        for key, w in words.items():
            for t, m in times.items():
                tf = w.count(t)
                if tf:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    scores[key] += m * round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) * 1_000_000)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, *key, round(s / 1_000_000, 4), i) for i, (key, s) in enumerate(best, 1)]
    return sorted(out)


def test_passage_search_equals_formula(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    passages = [(d, c, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 40)))) for d in range(80) for c in range(3)]
    passages += [(900, 0, passages[0][2]), (901, 0, ""), (902, 0, None), (903, 0, "  ")]
    queries = [(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(10)] + [(20, "W1  w1\nw2"), (21, "unknown"), (22, None), (23, "")]
    df = spark.createDataFrame(passages, "doc_id long, chunk_id int, text string").repartition(4)
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = PI.build(df, str(tmp_path / "ix"), ["doc_id", "chunk_id"])
    got = PI.search(PI.open_index(spark, str(tmp_path / "ix")), q, k=7)
    assert got.columns == ["query_id", "doc_id", "chunk_id", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == bm25(passages, queries, 7)
    assert PI.search(index, q.limit(0)).count() == 0
    none = PI.build(df.limit(0), str(tmp_path / "none"), ["doc_id", "chunk_id"])
    assert PI.search(none, q).count() == 0


def test_frequent_term_is_many_files(spark, tmp_path):
    """A term of every passage is spread over the partitions of the index, each a stretch of terms."""
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('all only', id % 7) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # the table is tiny
    try:
        postings = PI.build(df, str(tmp_path / "ix"), ["doc_id"]).postings
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = postings.selectExpr("input_file_name() AS f", "term").groupBy("f").pivot("term", ["all"]).count().collect()
    assert len(files) >= 6 and sum(r["all"] or 0 for r in files) == 4000 and max(r["all"] or 0 for r in files) < 1600


def matched(events, stages):
    """Stages that a greedy sequence matcher reaches, each event later than the one before."""
    i, last = 0, None
    for ts, kind in sorted(events):
        if i < len(stages) and kind == stages[i] and (last is None or ts > last):
            i, last = i + 1, ts
    return i


def test_funnel_equals_sequence_matcher(spark):
    rng = random.Random(5)
    stages, day = ["view", "click", "signup", "purchase"], dt.datetime(2024, 3, 1, 9)
    rows = [(u, day + dt.timedelta(minutes=rng.randint(0, 12)), rng.choice([*stages, "other"])) for u in range(300) for _ in range(rng.randint(0, 9))]
    rows += [(900, day, "click"), (900, day + dt.timedelta(minutes=5), "view"), (900, day + dt.timedelta(minutes=10), "click"),
             (901, day, "view"), (901, day, "click"), (None, day, "view"), (902, None, "view")]
    units = {}
    for u, ts, kind in rows:
        if u is not None and ts is not None:
            units.setdefault(u, []).append((ts, kind))
    # ties: the matcher sees a stage's event before later stages of the same minute, which do not count
    reached = [matched([(ts, k) for ts, k in ev], stages) for ev in units.values()]
    want = [sum(r > i for r in reached) for i in range(4)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string").repartition(3)
    got = A.funnel(df, stages).orderBy("stage_order").collect()
    assert [r["count"] for r in got] == want and matched(units[900], stages) == 2
    assert A.funnel(df.limit(0), stages).orderBy("stage_order").collect()[0]["count"] == 0


@pytest.mark.parametrize("asked, scores", [(PI.ASKED, PI.SCORES), (PI.ASKED, 1), (0, 1)])
def test_ranks_whatever_the_tasks(spark, tmp_path, monkeypatch, asked, scores):
    """Passages that go over several batches, ties, repeated and null keys; both ways to add up scores."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    passages = [(d, c, " ".join(rng.choices(words, [1 / (i + 1) for i in range(30)], k=12))) for d in range(60) for c in range(2)]
    passages += [(100 + d, 0, passages[7][2]) for d in range(20)]
    queries = [(i, " ".join(rng.choices(words, k=4))) for i in range(12)]
    df = spark.createDataFrame(passages, "doc_id long, chunk_id int, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    index = PI.build(df, str(tmp_path / "ix"), ["doc_id", "chunk_id"])
    monkeypatch.setattr(PI, "ASKED", asked)
    monkeypatch.setattr(PI, "SCORES", scores)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, PI.search(index, q, k=9).collect())) == bm25(passages, queries, 9)
        odd = spark.createDataFrame([(None, float("nan"), "a b"), (None, float("nan"), "a b"), (None, 1.0, "a b"), ("x", None, "a"), ("x", 1.0, "c")],
                                    "k string, v double, text string")
        found = PI.search(PI.build(odd, str(tmp_path / "odd"), ["k", "v"]), spark.createDataFrame([("p", "a"), (None, "c b")], "query_id string, text string"))
        got = sorted((r["query_id"] or "", r["k"] or "", str(r["v"]), r["rank"]) for r in found.collect())
        assert [g[:3] for g in got] == [("", "", "1.0"), ("", "", "nan"), ("", "x", "1.0"), ("p", "", "1.0"), ("p", "", "nan"), ("p", "x", "None")]
        assert sorted(g[3] for g in got) == [1, 1, 2, 2, 3, 3]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_are_split_and_sorted_once(spark):
    df = spark.createDataFrame([(1, "b a  b"), (1, "b a  b"), (2, ""), (3, None), (None, "A")], "doc_id long, text string")
    postings = PI.postings_of(df, ["doc_id"])
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, postings.collect()), key=str) == [("a", 1, 3, 2), ("a", None, 1, 1), ("b", 1, 3, 4)]
    assert plan.count("Sort [") == 1 and "HashAggregate" not in plan and plan.count("split(") == 1
