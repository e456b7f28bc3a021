"""Vector search against comparing every query with every row."""

import math
import random

import numpy as np

from tessera.operators import vector_index as VI


def test_search_is_exact(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, vec(), "a") for i in range(400)]
    rows += [(400 + i, rows[7][1], "copy") for i in range(200)]            # a hot cell, ties by id
    rows += [(900, [0.0] * 6, "zero"), (901, None, "null")]
    queries = [(i, vec()) for i in range(20)] + [(50, rows[7][1]), (51, [0.0] * 6), (52, None)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    asked = spark.createDataFrame(queries, "query_id long, query_vec array<double>")

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 4)

    for block in (3, 4096):
        got = VI.exact_search(corpus, asked, k=5, extra=["label"], block=block)
        assert got.columns == ["query_id", "vec_id", "label", "similarity", "rank"]
        by = {}
        for r in got.collect():
            by.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["similarity"])
        assert set(by) == set(range(20)) | {50}
        for q, v in queries[:21]:
            best = sorted(((-cosine(v, x), i) for i, x, _ in rows[:600]))[:5]
            assert [by[q][k + 1][0] for k in range(5)] == [i for _, i in best]
    none = VI.exact_search(corpus.limit(0), asked, extra=["label"])
    assert none.columns == got.columns and none.count() == 0
    assert VI.exact_search(corpus, asked.limit(0), extra=["label"]).count() == 0
    assert VI.exact_search(corpus.filter("vec_id < 3"), asked.filter("query_id = 0"), k=5).count() == 3


def _table(spark, n=3000, dim=12):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, dim))
    x = centre[rng.choice(6, n, p=[0.4, 0.3, 0.1, 0.1, 0.05, 0.05])] + 0.4 * rng.normal(size=(n, dim))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)


def test_index_recall_and_work(spark, tmp_path):
    emb = _table(spark)
    asked = emb.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query_vec")
    index = VI.build(emb, str(tmp_path / "ix"), extra=["label"], lists=16, sub=2, block=100)
    sizes = [len(r.ids) for r in index.lists.select("ids").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 160            # every row once; a large list is many blocks
    exact = VI.exact_search(emb, asked, k=5, extra=["label"])
    again = VI.open_index(spark, str(tmp_path / "ix"))
    got = VI.search(again, asked, k=5, probed=10, rerank=250)
    assert got.columns == exact.columns
    r = VI.recall(exact, got).first()
    assert r.queries == 60 and r.wanted == 300 and r.recall >= 0.9
    # full vectors are compared for the candidates alone, codes for the probed lists alone
    found = VI.candidates(again, asked, "query_id", "query_vec", 10, 250)
    assert found.count() == 60 * 250 < 0.1 * 60 * 3000
    # all lists and all rows as candidates: the exact result
    whole = VI.search(again, asked, k=5, probed=16, rerank=3000)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_index_of_few_rows(spark, tmp_path):
    emb = _table(spark, n=3)
    asked = emb.selectExpr("vec_id AS query_id", "embedding AS query_vec")
    index = VI.build(emb, str(tmp_path / "a"))
    assert VI.search(index, asked, k=5).count() == 9
    assert VI.search(index, asked.limit(0)).count() == 0
    none = VI.build(emb.limit(0), str(tmp_path / "b"), extra=["label"])
    assert VI.search(none, asked.limit(0)).count() == 0
    assert none.vectors.count() == 0


def test_codes_are_the_nearest_words():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 10))
    books = VI.Books.learn(x, 8, 4, 16)
    assert [b.shape for b in books.words] == [(16, 4), (16, 4), (16, 2)]
    home, codes = books.encode(x)
    for i in range(0, 500, 50):
        assert home[i] == np.argmin(((x[i] - books.centroids) ** 2).sum(1))
        rest = x[i] - books.centroids[home[i]]
        assert [np.argmin(((rest[s] - b) ** 2).sum(1)) for s, b in books.stretches()] == codes[i].tolist()
    q = rng.normal(size=(3, 10))
    t = books.tables(q)
    back = books.centroids[home] + np.concatenate([b[codes[:, i]] for i, b in enumerate(books.words)], axis=1)
    got = q @ books.centroids[home].T + sum(t[i][:, codes[:, i]] for i in range(3))
    assert np.allclose(got, q @ back.T, atol=1e-4)


def test_words_are_dealt_into_ranges_without_a_count_before(spark):
    from tessera.operators import passage_index as PI
    passages = spark.createDataFrame([(1, 0, "a b a"), (1, 0, "a c b"), (None, 1, "a"), (2, 0, None)], "doc_id long, chunk_id int, text string")
    found = PI.postings_of(passages, ["doc_id", "chunk_id"])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "rangepartitioning(term" in plan and "hashpartitioning" not in plan
    got = {(r["doc_id"], r["chunk_id"], r["term"], r["tf"], r["n_words"]) for r in found.collect()}
    assert got == {(1, 0, "a", 3, 3), (1, 0, "b", 2, 3), (1, 0, "c", 1, 3), (None, 1, "a", 1, 1)}
