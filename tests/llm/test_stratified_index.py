"""Operator 12 against the formula on every document."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import stratified_index as op
from tests.llm.util import DOCS, documents, with_clashes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank, None if void else d, -s) for rank, (s, void, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=20, **kw):
    d = with_clashes(documents(spark, [(i, t, "", "", 0) for i, t in docs]).repartition(4), "m", "score", "row", "terms")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = op.search(op.build(d, **{x: v for x, v in kw.items() if x != "query_chars"}), q, k=k,
                    **{x: v for x, v in kw.items() if x == "query_chars"})
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_terms():
    text = "Äpfel ÄPFEL don't x_1\x85y\xa0z İ 漢字,Z9\U0001f600 \x7f"
    assert [t.decode() for t in op.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("postings", [1, 60, 200_000])
def test_equals_formula(spark, postings):
    rng = random.Random(7)
    words = [f"w{i}" if i % 3 else f"É{i}" for i in range(120)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(120)], k=rng.choice([1, 3, 12, 13, 60, 200])))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in (900, 901, 7, 7)] + [(None, docs[7][1]), (None, docs[8][1].upper()), (1000, None), (1001, ""), (1002, " ,")]
    items = [(i, " ".join(rng.choices(words, k=9))) for i in range(12)] + [(3, docs[7][1]), (3, docs[7][1]), (50, "w1 W1, w1 absent"),
             (51, "absent"), (52, None), (53, "?!"), (None, "w2")]
    want = brute(docs, items)
    assert run(spark, docs, items, block_postings=postings, query_chars=40 if postings == 60 else 10**6) == want
    if postings == 60:
        assert run(spark, docs, items, k=500) == brute(docs, items, 500)


def test_visits_stop_at_the_bound(spark, monkeypatch):
    """Blocks whose bound is below the k-th score are not scored, and the result is the same."""
    scored = []
    plain = op.Block.scores
    monkeypatch.setattr(op.Block, "scores", lambda self, *a: scored.append(self.m) or plain(self, *a))
    docs = [(i, "rare common filler") for i in range(30)] + [(100 + i, "common " + "filler " * 40) for i in range(300)]
    index = op.build(documents(spark, [(i, t, "", "", 0) for i, t in docs]), block_postings=30).toArrow().combine_chunks()
    batch = index.to_batches()[0]
    q = op.Queries([(1, Counter([b"rare", b"common"]))])
    q.weight[:] = [2000, 10]
    best = op.Best(20)
    op.visit([op.Block(batch, i, q) for i in range(batch.num_rows)], q, [best])
    assert best.columns[2].tolist() == list(range(20)) and len(scored) < batch.num_rows / 3


def test_awkward_rows(spark):
    docs = [(r[0], r[1]) for r in DOCS]
    items = [(1, DOCS[0][1]), (2, "river1 word5 stone"), (3, "home about")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []
