"""An inverted index over passages, and ranked retrieval (BM25) from it.

``build`` writes, below one folder,

* ``postings``: (term, keys, tf, n_words), range-partitioned and sorted by (term, keys): files
  hold a stretch of terms, so a scan for a few terms skips the others by their statistics,
  and a frequent term is cut into as many files as its share of the rows asks for;
* ``terms``: (term, df, occurrences), one row a term;
* ``size``: passages and words in all, one row.

``search`` turns queries into (query, term, times, idf) rows. Up to ``ASKED`` of them go to the tasks:
postings of the asked terms alone are dealt by passage, and a task adds up the scores of its
passages for all queries in Arrow batches and sends the k best of each query. More rows are joined
with the postings on the term, and scores are added up in the tasks before they are shuffled.

Terms are the lower-cased words between single spaces, as ``text.index_documents`` leaves them.
A term's part of a score is rounded to a millionth, so sums do not depend on their order. Null
texts, empty queries and unknown terms match nothing; equal scores go by the keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
UNIT = 1_000_000
#: (query, term) rows that are sent to the tasks, and scores that a task adds up side by side.
ASKED, SCORES = 200_000, 4_000_000


@dataclass
class PassageIndex:
    postings: DataFrame
    terms: DataFrame
    size: DataFrame
    keys: list[str]


def words_of(text: str) -> F.Column:
    return F.array_remove(F.split(F.lower(F.col(text)), " ", -1), "")


def postings_of(passages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(term, keys, n_words, tf): a row for each term of each passage, in ranges of (term, keys), sorted by them.

    The words are dealt into ranges as they are and counted there: one shuffle, and no count
    before it, where a task would hold all the words of its files. They are sorted once and
    counted in this order: a maximum of texts rules out a hash aggregate, which would not hold
    a task's postings and sort them again."""
    # explode_outer: for explode, Spark filters by the size of the list, and splits the text once more
    words = passages.select(*keys, words_of(text).alias("_w")).select(*keys, F.size("_w").alias("n_words"), F.explode_outer("_w").alias("term"))
    ranged = words.filter(F.col("term").isNotNull()).repartitionByRange("term", *keys)
    counted = ranged.groupBy("term", *keys, "n_words").agg(F.count(F.lit(1)).alias("tf"), F.max("term").alias("_term"))
    return counted.sortWithinPartitions("term", *keys).select(F.col("_term").alias("term"), *keys, "n_words", "tf")


def build(passages: DataFrame, path: str, keys: list[str], text: str = "text") -> PassageIndex:
    spark = passages.sparkSession
    rows = postings_of(passages, keys, text).select("term", *keys, "tf", "n_words")
    rows.write.parquet(f"{path}/postings")
    postings = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")) \
        .sortWithinPartitions("term").write.parquet(f"{path}/terms")
    # a passage's length stands in each of its postings: tf adds up to it
    once = postings.groupBy(*keys).agg(F.sum("tf").alias("n"))
    once.agg(F.count(F.lit(1)).alias("passages"), F.sum("n").alias("words")).coalesce(1).write.parquet(f"{path}/size")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> PassageIndex:
    postings = spark.read.parquet(f"{path}/postings")
    return PassageIndex(postings, spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/size"),
                        [c for c in postings.columns if c not in ("term", "tf", "n_words")])


def query_terms(index: PassageIndex, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query, term, times, idf) of the terms that some passage has."""
    n = index.size.first()["passages"]
    spaced = F.regexp_replace(F.col(text), "[\\t\\n\\f\\r ]+", " ")
    asked = queries.select(F.col(query_id).alias("_q"), spaced.alias("_t")).select("_q", F.explode(words_of("_t")).alias("term"))
    asked = asked.groupBy("_q", "term").agg(F.count(F.lit(1)).alias("times"))
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(index.terms, "term").select("_q", "term", "times", idf.alias("idf"))


def search(index: PassageIndex, queries: DataFrame, k: int = 10, query_id: str = "query_id", text: str = "text",
           k1: float = K1, b: float = B) -> DataFrame:
    """query_id, keys, score (4 digits), rank: the k best passages of each query."""
    size = index.size.first()
    mean = (size["words"] or 0) / max(1, size["passages"])
    tf = F.col("tf")
    length = F.lit(1.0 - b) + F.lit(b) * F.col("n_words") / F.lit(mean or 1.0)
    part = F.round(F.col("idf") * tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * length) * UNIT).cast("long")
    asked = query_terms(index, queries, query_id, text)
    few = asked.limit(ASKED + 1).collect()
    if len(few) <= ASKED:
        ids = list(dict.fromkeys(r["_q"] for r in few))
        names = index.postings.sparkSession.createDataFrame(
            list(enumerate(ids)), T.StructType([T.StructField("_n", T.IntegerType()), T.StructField("_q", asked.schema["_q"].dataType)]))
        best = _ranked(_best_of_tasks(index, ids, few, part, k), "_n", index.keys, k).join(F.broadcast(names), "_n")
    else:
        hits = index.postings.join(asked, "term")
        best = _ranked(hits.groupBy("_q", *index.keys).agg(F.sum(part * F.col("times")).alias("_s")), "_q", index.keys, k)
    return best.select(F.col("_q").alias(query_id), *index.keys, F.round(F.col("_s") / UNIT, 4).alias("score"), "rank")


def _ranked(scores: DataFrame, query: str, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("_s"), *keys)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each run of equal keys (nulls are equal, NaN too)."""
    new = np.zeros(max(0, rows.num_rows - 1), bool)
    for key in keys:
        a, b = rows.column(key).slice(1), rows.column(key).slice(0, rows.num_rows - 1)
        if pa.types.is_nested(a.type):
            new |= np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
            continue
        unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy().astype(bool)
        if pa.types.is_floating(a.type):
            unlike &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy().astype(bool)
        new |= unlike | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy()).astype(bool)
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if rows.num_rows else np.empty(0, np.int64)


class _Best:
    """The k best passages of each query so far; passages come in the order of their keys, so earlier ones win ties."""

    def __init__(self, queries: int, k: int):
        self.k, self.seen = k, 0
        self.least = np.full(queries, -1.0)      # a passage must score more
        self.q, self.s, self.at, self.keys = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), None

    def add(self, scores: np.ndarray, found: np.ndarray, keys: pa.Table) -> None:
        """``scores``, ``found``: passages x queries; ``keys``: of the passages."""
        row, q = np.nonzero(found & (scores > self.least))
        if len(row):
            new = keys.take(pa.array(row))
            q, s, at = np.append(self.q, q), np.append(self.s, scores[row, q]), np.append(self.at, self.seen + row)
            order = np.lexsort((at, -s, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
            last = order[rank == self.k - 1]
            self.least[q[last]] = s[last]
            order = order[rank < self.k]
            self.keys = (pa.concat_tables([self.keys, new]) if self.keys is not None else new).take(pa.array(order)).combine_chunks()
            self.q, self.s, self.at = q[order], s[order], at[order]
        self.seen += len(scores)


def _best_of_tasks(index: PassageIndex, ids: list, asked: list, part: Column, k: int) -> DataFrame:
    """(keys, _n, _s): the k best passages of each task for each query; ``_n``: its place in ``ids``."""
    spark, keys = index.postings.sparkSession, index.keys
    idf = {r["term"]: r["idf"] for r in asked}
    number, of = {t: i for i, t in enumerate(idf)}, {q: i for i, q in enumerate(ids)}
    rows = np.array([(number[r["term"]], of[r["_q"]], r["times"]) for r in asked], np.int64).reshape(-1, 3)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    shared = spark.sparkContext.broadcast((np.searchsorted(rows[:, 0], np.arange(len(idf) + 1)), rows[:, 1], rows[:, 2].astype(float)))
    queries = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (start, q, times), best, rest = shared.value, _Best(queries, k), None

        def score(t: pa.Table, starts: np.ndarray) -> None:
            term, part = t.column("_t").to_numpy(), t.column("_p").to_numpy()
            hits = start[term + 1] - start[term]
            # as many passages at a time as have so many scores
            weight = np.maximum(np.add.reduceat(hits, starts), queries).cumsum()
            lo = 0
            while lo < len(starts):
                done = weight[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(weight, done + SCORES, "right")))
                a, z = starts[lo], starts[hi] if hi < len(starts) else len(term)
                n = hits[a:z]
                passage = np.repeat(np.searchsorted(starts[lo:hi], np.arange(a, z), "right") - 1, n)
                at = np.repeat(start[term[a:z]] - (n.cumsum() - n), n) + np.arange(n.sum())
                cell, size = passage * queries + q[at], (hi - lo) * queries
                sums = np.bincount(cell, np.repeat(part[a:z], n) * times[at], size).reshape(-1, queries)    # whole numbers, exact
                found = np.bincount(cell, minlength=size).reshape(-1, queries) > 0 if (part[a:z] == 0).any() else sums > 0
                best.add(sums, found, t.select(keys).take(pa.array(starts[lo:hi])))
                lo = hi
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            starts = _starts(t, keys)
            if len(starts) > 1:      # the last passage may go on in the next batch
                score(t.slice(0, starts[-1]), starts[:-1])
            rest = t.slice(starts[-1]) if len(starts) else rest
        if rest is not None and rest.num_rows:
            score(rest, np.zeros(1, np.int64))
        if best.keys is not None:
            for b in best.keys.append_column("_n", pa.array(best.q, pa.int32())).append_column("_s", pa.array(best.s.astype(np.int64))).to_batches():
                yield b
    terms = spark.createDataFrame([(t, number[t], v) for t, v in idf.items()], "term string, _t int, idf double")
    hits = index.postings.join(F.broadcast(terms), "term").select(*keys, "_t", part.alias("_p"))
    fields = [index.postings.schema[c] for c in keys]
    return hits.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        run, T.StructType([*fields, T.StructField("_n", T.IntegerType()), T.StructField("_s", T.LongType())]))
