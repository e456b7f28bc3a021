"""Operator 9 against comparing every line with every other."""

import collections

import numpy as np
import pytest

from tessera.llm import line_dedup as op
from tessera.llm.common import split_words, table
from tests.llm.util import DOCS, documents, with_clashes

SF = "/root/testdata/sf0.001"


def brute(rows, t=0.8):
    """{(doc_id, text): (n_lines, n_removed, links, kept)} by all pairs of distinct sets."""
    lines = []
    for d, x in {(d, x or "") for d, x in rows}:
        for i, line in enumerate(x.lower().split("\n")):
            s = frozenset(split_words(line))
            if s:
                lines.append(((d is None, d, x, i), s))
    # equal ids: ordered by the row key, which these inputs avoid
    lines.sort(key=lambda r: (r[0][0], r[0][1] or 0, r[0][3]))
    sets = list({s for _, s in lines})
    near = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for b in sets[:i]:
            c = len(a & b)
            if c and c / (len(a) + len(b) - c) >= t - 1e-12:
                near[a].add(b)
                near[b].add(a)
    seen, out = set(), collections.defaultdict(lambda: [0, 0, 0, []])
    for (_, d, x, i), s in lines:
        r = out[(d, x)]
        r[0] += 1
        r[2] += len(near[s])
        if s in seen or near[s] & seen:
            r[1] += 1
        else:
            r[3].append(i)
        seen.add(s)
    return out


@pytest.mark.parametrize("n", [200])
def test_equals_all_pairs(spark, n):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in op.line_figures(docs).collect()}
    assert len(got) == len(rows) == n
    for d, x in rows:
        assert [got[d].n_lines, got[d].n_removed, got[d].links, list(got[d].kept_numbers)] == list(want[(d, x)]), d


def test_near_lines_and_frequent_words(spark):
    base = " ".join(f"w{i}" for i in range(20))
    rows = [(1, base, "", "", 0), (2, base + " extra", "", "", 0), (3, base.replace("w3", "v3").replace("w4", "v4"), "", "", 0),
            (4, "a b c d e\na b c d e f\na b c d\na b c", "", "", 0)]
    rows += [(10 + i, f"a b c d e x{i} y{i}", "", "", 0) for i in range(200)]
    want = brute([r[:2] for r in rows])
    for r in [x for f in (5, op.FREQUENT) for x in op.line_figures(documents(spark, rows), frequent=f).collect()]:
        x = next(y[1] for y in rows if y[0] == r.doc_id)
        assert [r.n_lines, r.n_removed, r.links, list(r.kept_numbers)] == list(want[(r.doc_id, x)]), r.doc_id


def test_links_of_large_keys(spark, monkeypatch):
    """Rows of one key compared pair by pair and by marks; brute force over the sets of two templates."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        words = [f"{'ab'[i % 2]}{j}" for j in range(24)]
        for j in rng.choice(24, rng.integers(0, 5), replace=False):
            words[j] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words), "", "", 0))
    want = brute([r[:2] for r in rows])
    assert sum(w[2] for w in want.values()) > 1000
    real, calls = op.links_of_large, []
    monkeypatch.setattr(op, "links_of_large", lambda *a: (calls.append(a[1:3]), real(*a))[1])
    one = sorted({frozenset(r[1].split()): r for r in reversed(rows)}.values())      # each set once
    wanted = brute([r[:2] for r in one])
    texts = [r[1] for r in one]
    lines = op.Lines(texts).sets(op.Lines(texts).buckets())
    assert [op.Lines([x]).sets().ids()[0] for x in texts] == op.Lines(texts).sets().ids().tolist() == lines.ids().tolist()
    low = lines.low()
    # every token as a key: more than the prefixes hold
    keys = sorted((int(low[lines.start[i] + j]), int(lines.size[i]), i, j) for i in range(len(one)) for j in range(lines.size[i]))
    key, size, who, at = (np.array(x) for x in zip(*keys, strict=True))
    flat = np.concatenate([low[lines.start[i]:lines.start[i] + lines.size[i]] for i in who])
    for large in (2, 30, 10**9):
        monkeypatch.setattr(op, "LARGE", large)
        links, goes = op.count_links(key, size, at, at, who, flat, 0.8)
        assert np.bincount(who, links, len(one)).astype(int).tolist() == [wanted[r[:2]][2] for r in one]
        gone = set(who[goes].tolist())
        assert [i in gone for i in range(len(one))] == [wanted[r[:2]][1] == 1 for r in one]
    assert calls
    for frequent in (5, op.FREQUENT):
        got = {r.doc_id: r for r in op.line_figures(documents(spark, rows), frequent=frequent).collect()}
        for r in rows:
            g = got[r[0]]
            assert [g.n_lines, g.n_removed, g.links, list(g.kept_numbers)] == list(want[r[:2]]), r[0]


def test_words_of_a_batch(monkeypatch):
    """The hashed words are those of split_words, in texts with other separators, long words and empty lines."""
    texts = [None, "", "\n", "A b\tc\x0bd\x0c\x0d e", "\u00c9t\u00e9 \u2028x\u3000y\n\n z", "w" * 3000 + " tail", "a a a\n a"]
    monkeypatch.setattr(op, "PIECE", 64)
    got = op.Lines(texts)
    want = [(r, i, w) for r, t in enumerate(texts) for i, line in enumerate((t or "").lower().split("\n")) for w in split_words(line)]
    assert [(int(got.row[x]), int(got.number[x])) for x in got.line] == [w[:2] for w in want]
    kinds = {}
    for h, w in zip(got.hashes.tolist(), want, strict=True):
        assert kinds.setdefault(w[2], h) == h
    assert len(set(kinds.values())) == len(kinds)


def test_equal_rows_count_once(spark):
    rows = [(1, "a b c d e f\ng h", "", "", 0)] * 3 + [(2, "a b c d e f z", "", "", 0), (None, "a b c d e f y", "", "", 0)]
    got = sorted((r.doc_id or 9, r.n_lines, r.n_removed, r.links) for r in op.line_figures(documents(spark, rows)).collect())
    assert got == [(1, 2, 0, 2)] * 3 + [(2, 1, 1, 1), (9, 1, 1, 1)]


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark), "node", "row", "key", "links", "_size", "_key", "_row", "_source", "_doc", "_copies")
    out = op.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(DOCS)
    by_id = {r.doc_id: r.text for r in rows}
    assert by_id[3] == "" and by_id[4] is None and by_id[2] == "" and by_id[8] == " \t \n\n "
    assert op.line_figures(documents(spark, [])).count() == 0
