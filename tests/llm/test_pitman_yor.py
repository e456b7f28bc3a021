"""Operator 3: seating against exact expectations, a proper distribution, held-out perplexity."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import pitman_yor as op
from tessera.llm import table_counts
from tessera.llm.common import table
from tests.llm.util import DOCS, documents, with_clashes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("c,d,s", [(2, 0.5, 1.0), (7, 0.7, 1.0), (40, 0.3, 2.0), (300, 0.6, 0.5)])
def test_tables_of_one_dish(c, d, s):
    """With one dish of base probability 1 the posterior is the prior: E[t] is known."""
    n = 1500
    rng = np.random.default_rng(1)
    t = op.seat(rng, np.arange(n), np.full(n, c), np.ones(n), np.zeros(n), np.ones(n), d, s, 3, 1)[0]
    want = s / d * (math.exp(math.lgamma(s + d + c) + math.lgamma(s) - math.lgamma(s + d) - math.lgamma(s + c)) - 1)
    assert abs(t.mean() - want) < 5 * t.std() / math.sqrt(n) + 0.01 * want


def exact_tables(c, d, base, theta):
    """E[t] and its deviation under S(c, t) base^t prod (theta + d k), S by the recursion."""
    row = np.zeros(1)
    for n in range(1, c):
        t = np.arange(1, n + 1)
        new = np.full(n + 1, -np.inf)
        new[:-1] = row + np.log(n - d * t)
        new[1:] = np.logaddexp(new[1:], row)
        row = new
    k = np.arange(c)
    w = row + np.cumsum(np.log(base * (theta + d * k)))
    p = np.exp(w - w.max())
    p /= p.sum()
    mean = (p * (k + 1)).sum()
    return mean, math.sqrt((p * (k + 1) ** 2).sum() - mean ** 2)


@pytest.mark.parametrize("c,d,base,others", [(30, 0.7, 0.3, 0), (300, 0.7, 0.3, 0), (511, 0.5, 0.1, 40), (513, 0.5, 0.1, 40), (1000, 0.6, 0.5, 500),
                                             (2000, 0.7, 0.3, 0), (3000, 0.6, 0.5, 500), (3000, 0.9, 0.6, 5), (3000, 0.2, 0.9, 30)])
def test_tables_of_dishes_of_any_size(c, d, base, others):
    """Production sweeps, base probability below 1: the mean over restaurants of one dish is the exact one."""
    n, s = 3000, op.STRENGTH
    t = op.seat(np.random.default_rng(c), np.arange(n), np.full(n, c), np.full(n, base), np.full(n, float(others)), np.ones(n), d, s,
                op.BURN, 1)[0]
    mean, deviation = exact_tables(c, d, base, s + d * others)
    assert abs(t.mean() - mean) < 4.5 * deviation / math.sqrt(n) + 0.005 * mean
    assert abs(t.std() / deviation - 1) < 0.08


def test_two_dishes_equal_enumeration():
    """Two dishes in one restaurant: the joint distribution of their table numbers, summed over all seatings."""
    d, s, p = 0.6, 1.0, (0.3, 0.05)
    c = (4, 3)

    def ways(n, k):       # generalised Stirling numbers with discount d
        if n == k == 0:
            return 1.0
        if k == 0 or k > n:
            return 0.0
        return ways(n - 1, k - 1) + (n - 1 - d * k) * ways(n - 1, k)

    weight = {}
    for a in range(1, 5):
        for b in range(1, 4):
            up = math.prod(s + d * i for i in range(a + b))
            weight[a, b] = ways(4, a) * ways(3, b) * up * p[0] ** a * p[1] ** b
    total = sum(weight.values())
    n = 6000
    t = op.seat(np.random.default_rng(2), np.repeat(np.arange(n), 2), np.tile(c, n), np.tile(p, n), np.zeros(n), np.ones(n), d, s, 25, 1)[0]
    want = [sum(k[i] * v for k, v in weight.items()) / total for i in (0, 1)]
    got = t.reshape(-1, 2).mean(axis=0)
    assert abs(got[0] - want[0]) < 0.06 and abs(got[1] - want[1]) < 0.06, (got, want)


def test_ids_on_the_wire():
    rng = np.random.default_rng(3)
    for ids in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([(1 << 32) - 1, (1 << 33) - 2, 1 << 47], np.uint64),
                np.unique(rng.integers(0, 1 << 48, 1000).astype(np.uint64)), np.arange(50, dtype=np.uint64)):
        assert (op.unpack_sorted(op.pack_sorted(ids)) == ids).all() and (op.unpack_ids(op.pack_ids(ids)) == ids).all()


def test_base_score_and_counts(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: [w.decode() for w in r.text.encode().lower().split()] + ["\n"] for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in rows}
    count = Counter(w for d, ws in rows.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in op.op3_pitman_yor(spark, SF).collect()}
    assert set(got) == set(rows)
    tokens = score = base = 0
    for d, ws in rows.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        if held[d]:
            tokens, score, base = tokens + len(ws), score + r.score, base + r.base_score
    assert score / tokens > base / tokens + 0.3      # held-out perplexity at least halves


def test_probabilities_add_up(spark):
    """P(. | context) sums to 1 over the training words, the unknown word and the end, in every context.

    Texts "x" and "u x" give S(x) = P(x|end) P(end|x) and S(u x) = P(u|end) P(x|u) P(end|x), so
    P(x|u) = S(u x) / S(x) * P(x|end) / P(u|end). That every context sums to 1 is a linear system for
    P(.|end); its solution must sum to 1 with P(end|end), the score of the empty text.
    """
    texts = ["a b a b c a", "b a b a d", "a a a b", "c b a", "a b a b a b c", "e f"] * 3
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 != 0][:len(texts)]
    held = [i for i in range(200, 3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    vocab = ["a", "b", "c", "d", "e", "f", "unknown"]
    rows = [(i, t, "", "", 0) for i, t in zip(ids, texts, strict=True)]
    probe = {t: held.pop() for t in [""] + vocab + [f"{u} {x}" for u in vocab for x in vocab]}
    rows += [(i, t, "", "", 0) for t, i in probe.items()]
    by_id = {r.doc_id: 10 ** r.score for r in op.score(documents(spark, rows)).collect()}
    s = {t: by_id[i] for t, i in probe.items()}
    ratio = np.array([[s[f"{u} {x}"] / s[x] for x in vocab] for u in vocab])
    single = np.array([s[u] for u in vocab])
    first = np.linalg.solve(np.eye(len(vocab)) - ratio, single)      # first = ratio @ first + single
    assert (first > 0).all() and abs(first.sum() + s[""] - 1) < 1e-4
    follow = ratio * first[None, :] / first[:, None]
    assert np.abs(follow.sum(axis=1) + single / first - 1).max() < 1e-6
    assert first[0] == max(first)


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark), "k", "v", "id", "t")
    got = op.score(docs).collect()
    assert len(got) == len(DOCS) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True, True]
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 8)} == {1}
    again = {(r.doc_id, r.n_tokens): r.score for r in op.score(docs).collect()}
    assert all(again[(r.doc_id, r.n_tokens)] == r.score for r in got)
    assert op.score(documents(spark, [])).count() == 0


def test_distinct_values_and_their_places():
    distinct, expand, squeeze = op.distinct, op.expand, op.squeeze
    for x in (np.array([5, 1, 5, 2 ** 63, 1], np.uint64), np.array([], np.uint64), np.array([7, -3, 7], np.int64)):
        values, place = distinct(x)
        wanted, at = np.unique(x, return_inverse=True)
        assert values.tolist() == wanted.tolist() and place.tolist() == at.tolist() and values.dtype == x.dtype
        assert expand(squeeze(x), x.dtype).tolist() == x.tolist()


def test_distinct_values_come_from_plain_sorts():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << 48, 3000).astype(np.uint64)
    several = [np.empty(0, np.uint64), ids[:1], ids[rng.integers(0, 3000, 20000)], ids[rng.integers(0, 3000, 200000)],
               np.uint64(1 << 63) | ids, rng.integers(0, 50, 5000), (ids << np.uint64(16)) + rng.integers(0, 3, 3000).astype(np.uint64)]
    want = [np.unique(x, return_index=True, return_inverse=True) for x in several]
    clash = np.array([5, 4, 5, 6, 4], np.uint64)                 # alike but for the bits that a position takes
    of_clash = np.unique(clash, return_index=True, return_inverse=True)
    for x, (kinds, first, place) in zip(several, want, strict=True):
        got = op.distinct(x)
        assert got[0].dtype == x.dtype and (got[0] == kinds).all() and (got[1] == place).all()
        got = op.distinct_hashes(x.astype(np.uint64))
        assert (got[0] == first).all() and (got[1] == place).all()
    got = op.distinct_hashes(clash)
    assert (got[0] == of_clash[1]).all() and (got[1] == of_clash[2]).all()


def test_members_of_sorted_ids():
    ids = np.array([2, 5, 9], np.uint64)
    for some in ([], [5], [1, 2, 3, 9, 10], [9, 9]):
        some = np.array(some, np.uint64)
        assert op.held_in(ids, some).tolist() == np.isin(ids, some).tolist() and not len(op.held_in(ids[:0], some))


def test_a_chunk_has_the_words_of_its_texts():
    texts = ["", None, "  A b\x0bA\n", "\xa0x Y É é", "\t", "b" * 40 + "\x1cC \x0c \r z"]
    ch = op.Chunk(3, ["1", None, "2", "3", "4", "5"], pa.array(["left out", *texts], pa.string()).slice(1))
    words = [[*(t or "").encode().lower().split(), op.END] for t in texts]
    ids = [xxhash.xxh64_intdigest(w) >> 16 for ws in words for w in ws]
    assert ch.sizes.tolist() == [len(w) for w in words] and ch.ids[ch.token].tolist() == ids
    assert ch.doc.tolist() == [i for i, ws in enumerate(words) for _ in ws]
    assert op.Chunk(0, ["1"], pa.array([None], pa.string())).ids.tolist() == [op.END_ID]


def exact_logs(c, d):
    """log S(c, t) for t = 1 .. c by the recursion."""
    row = np.zeros(1)
    for n in range(1, c):
        new = np.full(n + 1, -np.inf)
        new[:-1] = row + np.log(n - d * np.arange(1, n + 1))
        new[1:] = np.logaddexp(new[1:], row)
        row = new
    return row


@pytest.mark.parametrize("d", [0.05, 0.4, 0.7])
def test_numbers_of_large_dishes(d):
    """Few tables: equal to the recursion. Many: the saddle point is where the slope of the exponent is nil."""
    for c in (600, 2000):
        want, t = exact_logs(c, d), np.arange(1.0, c + 1)
        t = t[t <= c ** d]
        assert np.abs(table_counts.Stirling(d, c).log(np.full(len(t), float(c)), t) - want[:len(t)]).max() < 1e-6
    for c in (600.0, 1e5, 1e7):
        t = np.unique(np.geomspace(c ** d, c - 1, 200).round())
        low, high = np.full(len(t), -60.0), np.full(len(t), -1e-15)
        for _ in range(90):
            x = (low + high) / 2
            right = np.log(t * d / c) + np.log(np.expm1(x) / np.expm1(d * x)) - (1 - d) * x > 0
            low, high = np.where(right, x, low), np.where(right, high, x)
        v, z = np.exp(low), -np.expm1(low)
        f = -np.expm1(d * low) / d
        curve = c + t * z * z * (1 - d) * v ** (d - 2) / f - c * c / t
        want = (table_counts.lgamma(c + 1) - table_counts.lgamma(t + 1) + t * np.log(f) - c * np.log(z)
                - 0.5 * np.log(2 * np.pi * np.maximum(curve, 1e-9)))
        got = table_counts.Stirling(d, 600)._saddle(np.full(len(t), c), t)
        ok = t < 0.99 * c                # beyond, the curvature is a difference of almost equal numbers
        assert np.abs(got - want)[ok].max() < 1e-9 * c + 1e-4, (c, np.abs(got - want)[ok].max())


def test_a_number_of_tables_costs_few_logarithms(monkeypatch):
    """Of many numbers asked for one count, each costs a few logs and exponentials, not one a term or bisection step."""
    cells = Counter()

    class Counting:
        def __getattr__(self, name):
            f = getattr(np, name)
            if name not in ("log", "exp", "expm1"):
                return f

            def counted(x, *a, **k):
                cells[name] += np.size(x)
                return f(x, *a, **k)
            return counted

    numbers = table_counts.Stirling(0.7, 5000)
    c = np.full(3000, 5000.0)
    monkeypatch.setattr(table_counts, "np", Counting())
    for t, most in ((np.linspace(1, 300, 3000).round(), 25), (np.linspace(500, 4000, 3000).round(), 60)):
        cells.clear()
        numbers.log(c, t)
        assert sum(cells.values()) < most * len(t), cells


def test_equal_tables_are_made_once():
    assert table_counts.Stirling(0.625, 300).table is table_counts.Stirling(0.625, 300).table


def test_small_dishes_are_picked_by_their_weight():
    weight = np.log(np.array([[1.0, 5.0], [2.0, 0.5], [7.0, 4.5]]))        # a column for each dish
    got = table_counts._pick(np.random.default_rng(5), np.repeat(weight, 20000, axis=1))
    for i, want in enumerate(([0.1, 0.2, 0.7], [0.5, 0.05, 0.45])):
        share = np.bincount(got[i * 20000:][:20000], minlength=3) / 20000
        assert np.abs(share - want).max() < 0.02


def test_small_dishes_without_logarithms(monkeypatch):
    """The same draws as from log weights, for base probabilities and rooms from tiny to huge."""
    rng = np.random.default_rng(6)
    n = 4000
    c, base, theta = rng.integers(2, 17, n), 10.0 ** rng.uniform(-12, 0, n), 10.0 ** rng.uniform(-0.3, 12, n)
    numbers = table_counts.Stirling(0.6, 16)
    with monkeypatch.context() as m:
        m.setattr(table_counts, "_pick", None)           # what takes log weights
        got = table_counts.draw(np.random.default_rng(7), numbers, c, base, theta)
    monkeypatch.setattr(table_counts, "PLAIN", 0)
    want = table_counts.draw(np.random.default_rng(7), numbers, c, base, theta)
    assert (got == want).all() and (got >= 1).all() and (got <= c).all() and len(np.unique(got)) > 8
