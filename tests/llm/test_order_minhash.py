"""Operator 10 against brute force over all pairs."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import order_minhash as op
from tessera.llm.bitvector import banded_distance, best_occurrence, match_masks
from tessera.llm.common import table
from tests.llm.util import DOCS, documents, with_clashes

SF = "/root/testdata/sf0.01"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bit_vectors_equal_the_table():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        k, d = rng.randint(0, 9), edit_distance(a, b)
        got = banded_distance(a, b, k)
        assert got == d if d <= k else got > k
        if a:
            best = min(edit_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
            assert best_occurrence(match_masks(a), len(a), b)[0] == best


def test_order_matters():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    swapped = np.concatenate([w[200:], w[:200]])
    one = op.sketch(op.labelled_kmers(w, 5), op.ENTRIES, op.ELL)
    assert (one == op.sketch(op.labelled_kmers(w.copy(), 5), op.ENTRIES, op.ELL)).all()
    assert (one == op.sketch(op.labelled_kmers(swapped, 5), op.ENTRIES, op.ELL)).sum() <= op.ENTRIES // 3


def test_finds_every_near_pair(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, op.text_words(r.text)) for r in docs.select("doc_id", "text").collect()]
    shingles, where = {}, collections.defaultdict(list)
    for d, w in rows:
        shingles[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
        for s in shingles[d]:
            where[s].append(d)
    common = collections.Counter()
    for ids in where.values():
        common.update((a, b) for i, a in enumerate(ids) for b in ids[:i])
    got = {r.doc_id: r.class_id for r in op.op10_order_minhash(spark, SF).collect()}
    assert set(got) == set(shingles)
    near = [(a, b) for (a, b), n in common.items() if n / (len(shingles[a]) + len(shingles[b]) - n) >= 0.8]
    assert near and all(got[a] == got[b] for a, b in near)
    # nothing is joined without a chain of links of at least the edit similarity
    words, members = dict(rows), collections.defaultdict(list)
    for d, c in got.items():
        members[c].append(d)
    for c, ids in members.items():
        assert c == min(ids)
        reached, rest = [c], [d for d in ids if d != c]
        while reached:
            a = words[reached.pop()]
            hit = [d for d in rest if banded_distance(a, words[d], max(len(a), len(words[d])) // 5)
                   <= 0.2 * max(len(a), len(words[d]))]
            reached += hit
            rest = [d for d in rest if d not in hit]
        assert not rest


def test_large_groups_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w), "", "", 0))
    passage = [f"p{i}" for i in range(60)]
    for i in range(300, 400):        # one passage in otherwise different texts: no near copies
        rows.append((i, " ".join([f"q{i}_{j}" for j in range(60)] + passage), "", "", 0))
    got = {r.doc_id: r.class_id for r in op.classes(documents(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(300))
    assert all(got[i] == i for i in range(300, 400))


def test_components_join_a_link_once_for_each_round_it_survives(spark, monkeypatch):
    rng, node = random.Random(4), lambda i: bytearray(i.to_bytes(2, "big"))
    links = {(i, i + 1) for i in range(64)}                                       # a chain in order
    links |= {tuple(sorted((200, j))) for j in range(100, 200)}                   # a star around its largest node
    links |= {tuple(sorted(rng.sample(range(300, 600), 2))) for _ in range(250)}
    best = {}
    for i in sorted({x for ab in links for x in ab}):
        if i not in best:
            reached = [i]
            for x in reached:
                reached += [y for a, b in links if x in (a, b) for y in (a, b) if y not in reached]
            best |= dict.fromkeys(reached, i)
    seen, plain = [], op.relabelled
    monkeypatch.setattr(op, "relabelled", lambda ls, up: seen.append(ls.count()) or plain(ls, up))
    df = spark.createDataFrame([(node(a), node(b)) for a, b in sorted(links)], "a binary, b binary")
    got = {int.from_bytes(r.node): int.from_bytes(r.label) for r in op.components(df).collect()}
    assert got == best
    assert sum(seen) < 2 * len(links)               # before: both directions of every link in every round
    part = df.filter(F.col("a") < F.lit(node(400)))
    again = op.joined(op.components(part), df.exceptAll(part))
    assert {int.from_bytes(r.node): int.from_bytes(r.label) for r in again.collect()} == best


def test_awkward_rows(spark):
    docs = with_clashes(documents(spark), "node", "label", "class", "_size", "_key", "_row", "_source", "_doc", "_copies")
    got = op.classes(docs).collect()
    assert len(got) == len(DOCS)
    by = {r.doc_id: r for r in got}
    assert by[1].class_id == by[2].class_id == 1 and by[7].copies == 2 and by[3].class_id == by[8].class_id == by[4].class_id == 3
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "10", "3", "7", "9", "None"]
    assert op.classes(documents(spark, [])).count() == 0 and op.keep_one(documents(spark, [])).count() == 0


def test_short_texts_with_a_word_added(spark):
    rows = []
    for i in range(240):         # 8 against 9, 9 against 10 ... words, the new word first or last
        w = [f"s{i}_{j}" for j in range(8 + i % 28)]
        rows += [(2 * i, " ".join(w), "", "", 0), (2 * i + 1, " ".join([*w, "new"] if i % 2 else ["new", *w]), "", "", 0)]
    got = {r.doc_id: r.class_id for r in op.classes(documents(spark, rows)).collect()}
    assert all(got[i] == i - i % 2 for i in range(480))


def test_large_bucket_equals_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for family in range(3):            # chains: neighbours differ by 15 words of 100, ends by 90
        words = [f"f{family}_{j}" for j in range(100)]
        for step in range(7):
            texts.append([f"g{family}_{j}" if j < 15 * step else w for j, w in enumerate(words)])
    hub = [f"h{j}" for j in range(100)]
    for i in range(600):               # versions around the limit of 0.8 from one another
        w = list(hub)
        for at in rng.sample(range(100), rng.randint(9, 30)):
            w[at] = f"v{i}_{at}"
        texts.append(w)
    docs = documents(spark, [(i, " ".join(w), "", "", 0) for i, w in enumerate(texts)])
    nodes = op.sketches(docs, "doc_id", "text", op.K, 1, op.ELL).select("node", "row", "doc_id")
    one = nodes.selectExpr("node", "row", "array(7L) AS entries")        # all in one bucket
    found = op.components(op.links_of(one, docs, "doc_id", "text", op.SIMILARITY, op.SMALL).distinct())
    label = {r.doc_id: r.label for r in nodes.join(found, "node").collect()}
    best = list(range(len(texts)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and sum(x != y for x, y in zip(texts[i], texts[j], strict=True)) <= 20:      # no shifts
                best[root(i)] = root(j)
    groups = collections.defaultdict(set)
    for i in range(len(texts)):
        groups[root(i)].add(label.get(i, i))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)
    assert 3 < len(groups) < 600
