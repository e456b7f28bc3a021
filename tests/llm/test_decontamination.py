"""Operator 7 against the edit distance of every stretch."""

import random

from tessera.llm import decontamination as op
from tests.llm.util import DOCS, documents, with_clashes


def nearest(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(6)]
    rows = []
    for d in range(60):
        item = list(items[d % 6][1])
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(item))
            kind = rng.random()
            item[i:i + 1] = [] if kind < 0.3 else [rng.choice("abcde")] if kind < 0.7 else [item[i], rng.choice("abcde")]
        rows.append((d, " ".join(word() for _ in range(15)) + " " + "".join(item).title() + "\n " + word(), "", "", 0))
    benchmark = spark.createDataFrame([*items, (7, None), (8, "short"), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in op.find_items(documents(spark, rows), benchmark, rate=0.1, block_chars=120).collect()}
    want = {}
    for d, t, *_ in rows:
        for i, x in items:
            n = nearest(op.normal(x), op.normal(t))
            if n <= int(0.1 * len(op.normal(x))):
                want[(d, i)] = n
    assert got == want and 30 < len(want) < 60
    kept = {r.doc_id for r in op.remove_contaminated(documents(spark, rows), benchmark, rate=0.1, block_chars=120).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark), "item_id", "distance")
    benchmark = spark.createDataFrame([(1, DOCS[0][1].split("\n")[0]), (1, DOCS[0][1].split("\n")[0])], "item_id long, text string")
    out = op.remove_contaminated(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["10", "3", "4", "7", "7", "8", "None"]
    assert op.find_items(docs, benchmark.limit(0)).count() == 0 and op.find_items(documents(spark, []), benchmark).count() == 0
