"""Operator 12: ranked lexical search over a length-stratified index.

The score of a document depends on a term's count tf and on the document's length only
through a whole number m, so documents of equal m form a stratum in which a term's part of
the score is one number for each tf:

    w * ((10^9 * tf) div (1000 * tf + 12 * m)),    m = 75 + (25 * n * N) div L

(n terms of the document, L terms of all N documents that have one, w the term's weight).

``build`` counts the terms of each whole text once (written to the shared folder), then
deals the documents by (m, part), where a stratum has a part for each ``BLOCK_POSTINGS``
of its postings: a stratum, however large, spreads over tasks, and tasks are alike in
postings, not in documents. A task writes its strata as blocks: the ids of documents of one
m, the block's terms, and each term's postings grouped by tf. A block ends at
``BLOCK_POSTINGS`` postings.

``search`` reads the index once for the document counts of the query terms and once for the
scores. A task computes each impact once per (term, tf) of a block, adds up each block's
bound for each query (the impacts of its highest tfs), visits the blocks by falling bound
and stops where the bound is below its k-th score so far. It sends its k best rows a query;
a ranked window merges them. Queries are the stated set: they go to the tasks in blocks of
``QUERY_CHARS`` characters, one block at a time.

Terms are runs of ASCII letters, digits and all characters from U+0080, A-Z lower-cased,
compared as bytes; all arithmetic is 64-bit integer but for the weights.

Defined results: null texts and texts without terms are not indexed and count nowhere;
queries without terms, or whose terms stand in no document, have no rows; equal scores go by
ascending id, missing ids last; rows with one id are documents of their own, repeated queries
give their rows each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, table

TOP = 20
#: (document, term) pairs in one block of the index: some 2 MB.
BLOCK_POSTINGS = 200_000
#: (document, term) pairs dealt to one task when the index is written: some 20 MB.
TASK_POSTINGS = 2_000_000
#: Characters of queries broadcast at a time.
QUERY_CHARS = 1_000_000
#: Bytes outside terms become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INDEX = ("m long, n_docs long, n_terms long, ids array<long>, terms binary, term_group array<int>, "
         "group_tf array<int>, group_at array<int>, postings array<int>")


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return text.translate(_FOLD).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) -> id, n, the distinct terms joined by spaces, their counts."""
    for b in batches:
        ids, ns, terms, tfs, sizes = [], [], [], [], [0]
        for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            found = terms_of(text.as_buffer().to_pybytes()) if text.is_valid else ()
            if found:
                counts = Counter(found)
                ids.append(key)
                ns.append(len(found))
                terms.append(b" ".join(counts))
                tfs.extend(counts.values())
                sizes.append(len(tfs))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()),
             pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(tfs, pa.int32()))],
            names=["id", "n", "terms", "tfs"])


def pack_block(m: int, docs: list[tuple]) -> dict:
    """One block of the index from (id, n, terms, tfs) rows of one m."""
    place: dict[bytes, int] = {}
    term = np.fromiter((place.setdefault(t, len(place)) for d in docs for t in d[2]), np.int64)
    tf = np.concatenate([d[3] for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d[3]) for d in docs])
    order = np.lexsort((doc, tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    group = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    first = np.flatnonzero(np.r_[True, term[group][1:] != term[group][:-1]])
    return {"m": m, "n_docs": len(docs), "n_terms": sum(d[1] for d in docs), "ids": [d[0] for d in docs],
            "terms": b" ".join(place), "term_group": np.r_[first, len(group)].astype(np.int32),
            "group_tf": tf[group].astype(np.int32), "group_at": np.r_[group, len(term)].astype(np.int32), "postings": doc}


_ARROW = pa.schema([("m", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("terms", pa.binary()), *[(c, pa.list_(pa.int32())) for c in ("term_group", "group_tf", "group_at", "postings")]])


def pack_strata(limit: int):
    """Rows (m, id, n, terms, tfs) sorted by m -> blocks of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([pack_block(at, docs)], _ARROW)

        at, docs, size = None, [], 0
        for b in batches:
            tfs = b.column(4)
            flat, offsets = tfs.values.to_numpy(), tfs.offsets.to_numpy()
            for i, (m, key, n, terms) in enumerate(zip(*[b.column(c).to_pylist() for c in range(4)], strict=True)):
                counts = flat[offsets[i]:offsets[i + 1]]
                if docs and (m != at or size + len(counts) > limit):
                    yield packed()
                    docs, size = [], 0
                at = m
                docs.append((key, n, terms.split(b" "), counts.copy()))
                size += len(counts)
        if docs:
            yield packed()

    return run


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", block_postings: int = BLOCK_POSTINGS,
          task_postings: int = TASK_POSTINGS) -> DataFrame:
    """The index of all documents that have a term, written to the shared folder (schema ``INDEX``)."""
    counted = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(
        count_terms, "id long, n long, terms binary, tfs array<int>")
    counted = cut(counted.withColumn("row", F.monotonically_increasing_id()), "term-counts")
    n_docs, n_terms, postings = counted.agg(F.count("*"), F.sum("n"), F.sum(F.size("tfs"))).first()
    counted = counted.withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms or 1}L"))
    # A row for each m, as a table of known size: Spark plans the join by it.
    parts = cut(counted.groupBy("m").agg(F.ceil(F.sum(F.size("tfs")) / block_postings).alias("parts")), "strata")
    dealt = counted.join(parts, "m").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    strata = (dealt.repartition(max(1, -(-(postings or 0) // task_postings)), "m", "part")
              .sortWithinPartitions("m", "part", F.col("id").asc_nulls_last(), "row"))
    blocks = strata.select("m", "id", "n", "terms", "tfs").mapInArrow(pack_strata(block_postings), INDEX)
    return cut(blocks, "stratified-index")


def query_blocks(items: DataFrame, key: str, text: str, chars: int) -> Iterator[list[tuple[int, Counter]]]:
    """(id, term counts) of the queries that have a term, in blocks of bounded size held one at a time."""
    block, size = [], 0
    for item, t in items.select(items[key].cast("long").alias("k"), items[text].alias("t")).toLocalIterator():
        counts = Counter(terms_of((t or "").encode()))
        if not counts:
            continue
        if block and size + len(t) > chars:
            yield block
            block, size = [], 0
        block.append((item, counts))
        size += len(t)
    if block:
        yield block


class Queries:
    """A block of queries: its terms in one numbering, each query as a stretch of (term, times)."""

    def __init__(self, block: list[tuple[int, Counter]]):
        self.items = [item for item, _ in block]
        self.place: dict[bytes, int] = {}
        self.term = np.array([self.place.setdefault(t, len(self.place)) for _, c in block for t in c], np.int64)
        self.times = np.array([n for _, c in block for n in c.values()], np.int64)
        self.first = np.cumsum([0] + [len(c) for _, c in block])
        self.weight = np.zeros(len(self.place), np.int64)


def numbers(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


class Block:
    """The query terms of one block of the index, with their impacts."""

    def __init__(self, batch: pa.RecordBatch, i: int, q: Queries):
        ids = batch.column("ids")[i].values
        self.void = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.m = batch.column("m")[i].as_py()
        self.postings, self.group_at = numbers(batch, "postings", i), numbers(batch, "group_at", i)
        groups, tfs = numbers(batch, "term_group", i), numbers(batch, "group_tf", i).astype(np.int64)
        wanted, self.groups, self.parts = q.place, {}, {}
        highest = np.zeros(len(wanted), np.int64)
        for at, t in enumerate(batch.column("terms")[i].as_py().split(b" ")):
            n = wanted.get(t)
            if n is not None:
                a, b = groups[at], groups[at + 1]
                tf = tfs[a:b]
                impact = q.weight[n] * (1_000_000_000 * tf // (1000 * tf + 12 * self.m))
                self.groups[n] = (a, b, impact)
                highest[n] = impact[-1]
        self.bounds = np.add.reduceat(highest[q.term] * q.times, q.first[:-1])

    def part(self, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Documents that hold term ``n`` and what it adds to their scores."""
        if n in self.groups and n not in self.parts:
            a, b, impact = self.groups[n]
            self.parts[n] = (self.postings[self.group_at[a]:self.group_at[b]],
                             np.repeat(impact, np.diff(self.group_at[a:b + 1])))
        return self.parts.get(n)

    def scores(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.ids), np.int64)
        for n, t in zip(terms.tolist(), times.tolist(), strict=True):
            part = self.part(n)
            if part:
                total[part[0]] += part[1] * t
        return total


class Best:
    """The k best documents of one query so far: score, void (id is missing), id."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.columns = [np.empty(0, np.int64)] * 3

    def add(self, score: np.ndarray, void: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor
        if len(score) > self.k:
            floor = max(floor, int(np.partition(score, -self.k)[-self.k]))
        at = np.flatnonzero(score >= floor)
        if len(at):
            merged = [np.concatenate(c) for c in zip(self.columns, (score[at], void[at], ids[at]), strict=True)]
            order = np.lexsort((merged[2], merged[1], -merged[0]))[:self.k]
            self.columns = [c[order] for c in merged]
            if len(order) == self.k:
                self.floor = max(1, int(self.columns[0][-1]))


def visit(blocks: list[Block], q: Queries, best: list[Best]) -> None:
    """Score the blocks for each query, highest bound first, as far as a bound may reach its k best."""
    bounds = np.array([b.bounds for b in blocks])
    order = np.argsort(-bounds, axis=0, kind="stable")
    for i, top in enumerate(best):
        stretch = slice(q.first[i], q.first[i + 1])
        terms, times = q.term[stretch], q.times[stretch]
        for b in order[:, i]:
            if bounds[b, i] < top.floor:
                break
            top.add(blocks[b].scores(terms, times), blocks[b].void, blocks[b].ids)


def document_counts(index: DataFrame, q: Queries) -> dict[int, int]:
    """term number -> documents that hold it."""
    shared = index.sparkSession.sparkContext.broadcast(q.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            for i in range(b.num_rows):
                at, groups = numbers(b, "group_at", i), numbers(b, "term_group", i)
                for j, t in enumerate(b.column("terms")[i].as_py().split(b" ")):
                    n = shared.value.get(t)
                    if n is not None:
                        found[n] += int(at[groups[j + 1]] - at[groups[j]])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())],
                                         names=["term", "df"])

    counts = index.select("terms", "term_group", "group_at").mapInArrow(run, "term long, df long")
    return {r.term: r.df for r in counts.groupBy("term").agg(F.sum("df").alias("df")).collect()}   # one row a query term


def search(index: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", k: int = TOP,
           query_chars: int = QUERY_CHARS) -> DataFrame:
    """The k best documents of each query with a score above 0: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    out = None
    n_docs = index.agg(F.sum("n_docs")).first()[0] or 0
    for block in query_blocks(items, key, text, query_chars):
        q = Queries(block)
        for n, df in document_counts(index, q).items():
            q.weight[n] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        shared = spark.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best = [Best(k) for _ in q.items]
            for b in batches:
                if b.num_rows:
                    visit([Block(b, i, q) for i in range(b.num_rows)], q, best)
            score, void, ids = (np.concatenate([x.columns[c] for x in best]) for c in range(3))
            slot = np.repeat(np.arange(len(best)), [len(x.columns[0]) for x in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array([q.items[s] for s in slot], pa.int64()), pa.array(ids, mask=void.astype(bool)),
                 pa.array(score)], names=["slot", "item_id", "doc_id", "score"])

        found = index.mapInArrow(run, "slot long, item_id long, doc_id long, score long")
        order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionAll(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
ORACLE_SQL = f"""
WITH d AS (SELECT r, doc_id, len(ts) AS n, ts
           FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents) WHERE len(ts) > 0),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT qr, item_id, term, count(*) AS times
      FROM (SELECT qr, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS qr, item_id, {_TERMS} AS ts FROM benchmark))
      GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, docs),
m AS (SELECT r, doc_id, 75 + (25 * n * docs) // terms AS m FROM d, size),
s AS (SELECT qr, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY qr ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER o <= {TOP}
"""
