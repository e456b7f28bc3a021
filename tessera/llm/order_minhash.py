"""Operator 10: near-duplicate classes by Order MinHash.

A text is its lower-cased words; its k-mers are its runs of five words, each
labelled with its occurrence number. One sketch entry takes, under its own hash
function, the ``ELL`` smallest labelled k-mers and keeps them in text order, so
two texts share an entry only if they share the k-mers and their order (edit
similarity rather than mere set similarity). Two texts that share an entry are a
candidate; it is a link if a banded alignment of the two word sequences gives an
edit similarity (1 - distance / longer length) of at least 0.8. Classes are the
connected components of the links.

Texts with the same words are one node from the start, so a group of copies of any
size costs one node. In a bucket (equal entry) of up to ``SMALL`` nodes all pairs
are checked; in a larger one every node is checked against one hub, and then every
node that no chain of links has joined to the hub against all others of the bucket it
is not joined to, in blocks spread over tasks. So every pair that shares an entry is
compared or in one class already, and no bucket is cut off; work is quadratic only in
nodes that share an entry and are not near copies (a common passage), where nearly all
pairs end at a comparison of word counts. With 32 entries of 6 k-mers, a pair of
five-word-shingle similarity 0.8 shares no entry with probability 0.00006 (by 0.8 ** 6
an entry; 16 entries of 4, the first version, had 0.0002). Small texts are worse off,
as a text of fewer than 6 k-mers takes them all; so texts of fewer than ``SHORT``
k-mers, and those that can be similar to them, also have as entries the k-mers of a
prefix filter: a pair with such a text and similarity 0.8 always shares one.

``links`` counts the links found; a pair in one class already may not be compared.

Every step is a Spark aggregate or join; hub keys are left to AQE's skew join;
links, labels and sketches stay in tables of the shared folder.

Defined results: null and empty texts are equal copies (no words); texts of fewer
than five words have one k-mer, all their words; rows with equal words are copies
whatever their ids, repeated rows and repeated ids too; a class is named by its
smallest doc_id (null if all its ids are null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bitvector import banded_distance
from tessera.llm.common import cut, split_words, table, whole_row

K = 5
ENTRIES = 32
ELL = 6
SIMILARITY = 0.8
#: Texts of fewer k-mers are also joined exactly, on their prefixes.
SHORT = 30
SMALL = 12
#: Nodes of a large bucket that are compared in one task with as many others, and bins of their word counts.
BLOCK = 256
BINS = 128

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(1, 1 << 63, 64, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P
    return (x ^ (x >> np.uint64(29))) * _Q


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=len(words) > 50)


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in text order."""
    n = len(words) - k + 1
    if n <= 0:
        k, n = len(words), 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _P + words[j:j + n]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if same.any():
        at = np.arange(n)
        first = np.maximum.accumulate(np.where(same, 0, at))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (at - first).astype(np.uint64)
        h = mix(h + occurrence * _Q)
    return h


def sketch(kmers: np.ndarray, entries: int, ell: int) -> np.ndarray:
    """``entries`` 64-bit entries: the ell smallest k-mers under each hash, kept in text order."""
    x, m = kmers[None, :], _XOR[:entries, None]
    keys = (x ^ m) * _MUL[:entries, None]
    keys ^= keys >> np.uint64(31)
    if kmers.size > ell:
        at = np.sort(np.argpartition(keys, ell - 1, axis=1)[:, :ell], axis=1)
    else:
        at = np.broadcast_to(np.arange(kmers.size), (entries, kmers.size))
    out = _XOR[:entries] + np.uint64(kmers.size if kmers.size < ell else 0)
    with np.errstate(over="ignore"):
        for j in range(at.shape[1]):
            out = mix(out * _P + kmers[at[:, j]])
    return out


def prefix(kmers: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The k-mers that a short text is joined on (none for a long one).

    Two sets of that Jaccard similarity share at least ceil(similarity * n) of either's n
    elements, so the first n - ceil(similarity * n) + 1 of both in one order have one in common.
    """
    n = kmers.size
    if n * similarity >= SHORT:
        return np.empty(0, np.uint64)       # longer than any text that a short one can be similar to
    return np.sort(mix(kmers ^ _Q))[:n - math.ceil(n * similarity - 1e-9) + 1]


def text_words(text: str | None) -> list[str]:
    return split_words((text or "").lower())


def row_key(key: str, text: str):
    """Tells rows apart by id and text; equal rows are equal."""
    return F.xxhash64(F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")))


def sketches(docs: DataFrame, key: str, text: str, k: int, entries: int, ell: int) -> DataFrame:
    """doc_id, row, node (128-bit digest of the words), n_words, entries of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, n_words, rows, offsets = [], [], [], [0]
            for t in b.column(2).to_pylist():
                words = text_words(t)
                nodes.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
                n_words.append(len(words))
                if words:
                    kmers = labelled_kmers(word_hashes(words), k)
                    rows += [sketch(kmers, entries, ell).view(np.int64), prefix(kmers).view(np.int64)]
                offsets.append(offsets[-1] + (rows[-2].size + rows[-1].size if words else 0))
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(n_words, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["doc_id", "row", "node", "n_words", "entries"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(key, text).alias("row"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, row long, node binary, n_words long, entries array<long>")


def node_words(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """node, words (32-bit hashes) of the wanted nodes; ``wanted`` has one row of each: (row, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_hashes(text_words(t)).astype("<u4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["node", "words"])

    rows = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text")).join(wanted, "row").select("node", "text")
    # only equal rows (same id, same text) come twice
    return rows.mapInArrow(run, "node binary, words binary").dropDuplicates(["node"])


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    longer = max(len(x), len(y))
    k = int((1 - similarity) * longer + 1e-9)
    if abs(len(x) - len(y)) > k:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    if len(differ) + longer - n <= k:
        return True        # an alignment along the main diagonal is enough
    head = int(differ[0])
    x, y = x[head:], y[head:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    x, y = x[:len(x) - tail], y[:len(y) - tail]
    u, c = np.unique(x, return_counts=True)
    v, d = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if max(len(x), len(y)) - int(np.minimum(c[i], d[j]).sum()) > k:
        return False       # too few words in common for any alignment
    return banded_distance(x.tolist(), y.tolist(), k) <= k


def verify(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words align with at least the given edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(p, q, similarity) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return both.mapInArrow(run, "a binary, b binary")


def across(members: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join members of a bucket which no link has joined yet.

    ``members``: key, node, label, apart (not in the hub's class). A bucket is dealt into
    blocks, those of the nodes apart first, and each pair of blocks with such a node
    is a group of its own. In a group every pair of different classes is compared: by
    lengths and word counts in ``BINS`` bins (each edit changes two counts by one or one
    by one, so no similar pair fails), then by alignment; a link joins the two classes.
    """
    counted = members.groupBy("key").agg(F.count_if("apart").alias("n_apart"), F.count_if(~F.col("apart")).alias("n_in")).filter("n_apart > 0")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    dealt = (members.join(counted, "key").withColumn("p", blocks("n_apart")).withColumn("q", blocks("n_in"))
             .withColumn("h", F.xxhash64("node", "key"))
             .withColumn("block", F.when(F.col("apart"), F.pmod("h", "p")).otherwise(F.col("p") + F.pmod("h", F.greatest("q", F.lit(1))))))
    with_block = F.explode(F.sequence(F.lit(0), F.when(F.col("apart"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1))
    groups = (dealt.select("key", "node", "label", "block", with_block.alias("other"))
              .select("key", "node", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                      (F.col("block") <= F.col("other")).alias("first"))
              .join(words, "node").select("key", "lo", "hi", "first", "node", "label", "words"))

    def run(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        first = np.array(group.column("first").to_pylist(), bool)
        node, label, text = (group.column(c).to_pylist() for c in ("node", "label", "words"))
        sets = [np.frombuffer(t, "<u4") for t in text]
        n = np.array([len(x) for x in sets])
        counts = np.stack([np.bincount(x % BINS, minlength=BINS) for x in sets]).astype(np.int32)
        up = {c: c for c in label}

        def root(c: bytes) -> bytes:
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        links = []
        for i in np.flatnonzero(first):
            others = np.arange(i + 1, len(node)) if lo == hi else np.flatnonzero(~first)
            longer = np.maximum(n[i], n[others])
            apart = np.abs(n[i] - n[others])
            k = ((1 - similarity) * longer + 1e-9).astype(np.int64)
            others, k, apart = (v[apart <= k] for v in (others, k, apart))
            near = np.abs(counts[others] - counts[i]).sum(axis=1) <= 2 * k - apart
            for j in others[near]:
                p, q = root(label[i]), root(label[j])
                if p != q and similar(text[i], text[j], similarity):
                    up[p] = q
                    links.append(sorted((node[i], node[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([y for _, y in links], pa.binary())})

    return groups.groupBy("key", "lo", "hi").applyInArrow(run, "a binary, b binary")


def links_of(nodes: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, small: int) -> DataFrame:
    """Verified links (a, b) between nodes. ``nodes``: node, row, entries (one row per node)."""
    return linked(nodes, docs, key, text, similarity, small)[0]


def linked(nodes: DataFrame, docs: DataFrame, key: str, text: str, similarity: float, small: int) -> tuple[DataFrame, DataFrame]:
    """The links of ``links_of``, each once, and their ``components``."""
    # an entry's value differs by its place in the sketch; prefixes of short texts are equal at any place
    rows = nodes.filter(F.size("entries") > 0).select("node", F.explode(F.array_distinct("entries")).alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    active = cut(rows.join(buckets, "key"), "omh-rows")
    large = active.filter(F.col("n") > small)
    pairs = large.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # at most ``small`` nodes a key: a bounded list each
    lists = (active.filter(F.col("n") <= small).groupBy("key")
             .agg(F.array_sort(F.collect_list("node")).alias("nodes")))
    tails = lists.select(F.posexplode("nodes").alias("i", "a"), "nodes").select(
        "a", F.explode(F.expr("slice(nodes, i + 2, size(nodes))")).alias("b"))
    pairs = pairs.unionByName(tails).distinct()
    wanted = nodes.join(active.select("node").distinct(), "node").select("row", "node")
    words = cut(node_words(docs, key, text, wanted), "omh-words")
    found = cut(verify(pairs, words, similarity), "omh-links-hub")
    labels = components(found)
    if large.isEmpty():
        return found, labels
    of_hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    members = (large.join(labels, "node", "left").join(of_hub, "hub", "left")
               .select("key", "node", F.coalesce("label", "node").alias("label"), F.coalesce("hub_label", "hub").alias("hub_label")))
    members = cut(members.select("key", "node", "label", (F.col("label") != F.col("hub_label")).alias("apart")), "omh-members")
    more = cut(across(members, words, similarity).distinct(), "omh-links-across")     # of different labels: none is in ``found``
    return found.unionByName(more), joined(labels, more)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the links, for every node that has one.

    Each round points every node to its smallest neighbour (or itself), follows the pointers to
    their roots and goes on with the links between roots alone: a link is joined with labels once
    for each round it survives, and a group of near copies seldom survives one.
    """
    rounds = []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "omh-up")
        while True:
            above = up.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
            new = cut(up.join(above, up["label"] == above["_n"]).select(
                "node", F.col("_l").alias("label"), (F.col("_l") != F.col("label")).alias("moved")), "omh-roots")
            up = new.select("node", "label")
            if new.filter("moved").isEmpty():
                break
        rounds.append(up)
        links = cut(relabelled(links, up), "omh-between")
        if links.isEmpty():
            break
    labels = rounds.pop()
    while rounds:
        labels = cut(under(rounds.pop(), labels), "omh-labels")
    return labels


def relabelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links between different labels, as links of these, each once; nodes without a label are their own."""
    of = [labels.select(F.col("node").alias(n), F.col("label").alias(v)) for n, v in (("a", "p"), ("b", "q"))]
    ends = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
    return ends.filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def under(labels: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, label) with each label replaced by its own label in ``tops``, if it has one."""
    above = tops.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return labels.join(above, labels["label"] == above["_n"], "left").select("node", F.coalesce("_l", "label").alias("label"))


def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
    """The ``components`` of the links that ``labels`` came from and ``more``."""
    tops = components(cut(relabelled(more, labels), "omh-between"))
    ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
    new = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return cut(under(labels.unionByName(new), tops), "omh-labels")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, entries: int = ENTRIES, ell: int = ELL,
            similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """One row per input row: doc_id, node (digest of the words), class_id, copies, links."""
    sk = cut(sketches(docs, key, text, k, entries, ell), "omh-sketches")
    nodes = cut(sk.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("copies"),
                                       F.first("entries").alias("entries")), "omh-nodes")
    links, labels = linked(nodes, docs, key, text, similarity, small)
    degree = (links.select(F.col("a").alias("n")).unionByName(links.select(F.col("b").alias("n")))
              .groupBy("n").agg(F.count("*").alias("links")))
    named = (nodes.select("node", "doc_id", "copies")
             .join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
             .join(degree, F.col("node") == F.col("n"), "left")
             .select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label"),
                     F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    named = cut(named, "omh-named")
    # a table of its own, so that the join below deals a large class's nodes anew (skew join) after the aggregate
    names = cut(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "omh-names")
    per_node = named.join(names, "label").select("node", "class_id", "copies", "links")
    return sk.select("doc_id", "row", "node", "n_words").join(per_node, "node")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One document of each class: the first row by (id, nulls last; row key); all columns."""
    found = classes(docs, key, text, **params).withColumn("class", F.coalesce(F.col("class_id").cast("string"), F.hex("node")))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = found.groupBy("class").agg(best.alias("b"), F.count("*").alias("n")).select(F.col("b.row").alias("_row"))
    out = docs.select(whole_row(docs), row_key(key, text).alias("_key")).join(kept, F.col("_key") == F.col("_row"))
    # equal rows (same id and text) share a key: one of them stays
    return out.dropDuplicates(["_key"]).select("_doc.*")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "copies", "links")
