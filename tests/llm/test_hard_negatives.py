"""Operator 13 against plain loops over whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as op
from tests.llm.util import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 9), (40, 33, 65), (64, 64, 64), (3, 200, 130)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(5)
    p, q, r = shape
    a, b = rng.integers(-2**62, 2**62, (p, q)), rng.integers(-2**62, 2**62, (r, q))
    assert (op.strassen(a, b, 4) == a @ b.T).all()   # modulo 2^64


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(2)
    n = 500
    columns = [rng.integers(0, 6, n), rng.integers(0, 9, n), rng.integers(0, 2, n), rng.integers(0, 40, n), np.arange(n)]
    whole = op.Heaps(4)
    whole.push(*columns)
    parts = []
    for part in np.array_split(rng.permutation(n), 7):
        parts.append(op.Heaps(4))
        for half in np.array_split(part, 2):
            parts[-1].push(*[c[half] for c in columns])
    got = op.Heaps.merged(4, parts)
    assert all((x == y).all() for x, y in zip(whole.columns, got.columns, strict=True)) and len(whole.columns[0]) == 24
    assert len(op.Heaps.merged(4, []).columns[0]) == 0


def brute(rows):
    clean = []
    for row, (key, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.append((row, key, (label + 1) % 10 if key is not None and key % 7 == 0 else label,
                      [math.floor(256 * float(np.float32(x))) for x in v]))
    by = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for row, key, label, v in clean:
        if key is None or key % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), k, lab) for r, k, lab, w in clean if r != row]
        positives = sorted((s for s in scored if s[2] == label), key=by)[:5]
        for ps, pid, _ in positives:
            window = sorted((s for s in scored if s[2] != label and 30 * ps <= 100 * s[0] <= 90 * ps), key=by)[:10]
            out += [(key, pid, i, nid, ps, ns) for i, (ns, nid, _) in enumerate(window, 1)]
    return out


def mine(spark, rows, **kw):
    e = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(5), "row", "score", "slot")
    label = F.when(e.vec_id % 7 == 0, (e.label + 1) % 10).otherwise(e.label)
    got = op.mine(e, "vec_id", "embedding", label, e.vec_id % 100 == 0, **kw)
    return [tuple(r)[:6] for r in got.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_equals_loops(spark, monkeypatch):
    monkeypatch.setattr(op, "ANCHOR_TILE", 3)
    rng = random.Random(4)
    centre = [[rng.uniform(-1, 1) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(700):
        c = centre[rng.randrange(4)]
        rows.append((i, [round(x + rng.uniform(-0.6, 0.6), 1) for x in c][:rng.choice([9, 9, 9, 5, 0])], rng.randrange(3)))
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[3][1], 1), (None, rows[200][1], 2), (None, rows[300][1], 0),
             (800, None, 1), (900, [0.1, None], 1), (1000, [float("nan")] * 9, 1), (1100, [float("inf")], 0), (1200, [0.5] * 9, None),
             (-100, rows[100][1], 1), (7_000_000_000_000_000_100, rows[100][1], 1)]
    want = brute(rows)
    assert len(want) > 250 and any(r[3] is None or r[1] is None for r in want)
    assert order(mine(spark, rows, block=4)) == order(want)
    assert order(mine(spark, rows)) == order(want)


def test_empty_and_too_large(spark):
    assert mine(spark, []) == [] and mine(spark, [(1, [1.0], 1)]) == [] and mine(spark, [(0, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mine(spark, [(0, [1e9], 1), (1, [1.0], 1)])
