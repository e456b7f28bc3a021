"""Vector search: exact, and by an index of inverted lists with product-quantised codes.

Similarity is the cosine, compared at 4 digits, ties by id; rows and queries with a null or
zero vector, or a null or non-finite component, have none and are left out.

``exact_search`` compares each query with each row, in blocks of queries of bounded size: a
block goes to the tasks as a broadcast, a task multiplies it with batches of rows and sends
its k best rows a query, and a ranked window (pre-limited) merges them. Rows are not moved.

``build`` learns coarse centroids and, for each stretch of ``SUB`` components, a codebook of
residuals, from a bounded sample (``SAMPLE`` rows, those with the smallest id hash); the sample
bounds the fit only. Every row then gets its list (nearest centroid) and its codes (nearest
codeword of each stretch), 1 byte a stretch. The index is three written tables:

* ``lists``: (list, block, ids, codes), blocks of about ``BLOCK`` rows, so that a list that
  holds a third of all rows is many rows of the table;
* ``vectors``: (id, vector, extra columns), what candidates are ranked by at the end;
* ``codebooks``: centroids and codewords, one row.

``search`` joins queries, grouped by the lists they probe, with the lists' blocks; a row of
that join is a block and up to ``GROUP`` queries, whose asymmetric distances are sums of
table entries. The best ``rerank`` candidates a query are joined with their vectors and ranked
by the exact cosine. Queries are a table of any size; nothing but the codebooks is broadcast.

What it saves and loses depends on the data: ``recall`` measures both against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import cosine_similarity
from tessera.session import scratch_dir

#: Queries of one broadcast block (64 dimensions: 2 MB).
QUERY_BLOCK = 4096
#: Rows that the codebooks are learnt from, at most.
SAMPLE = 16384
#: Coarse lists, share of them that a query probes, candidates ranked exactly.
LISTS, PROBED, RERANK = 64, 0.75, 150
#: Sample rows a list, at least (a small corpus has fewer lists).
LEAST = 32
#: Components of one stretch and codewords of its book (at most 256: a code is one byte).
SUB, WORDS = 4, 64
#: Rows in one block of a list, queries joined with a block at a time.
BLOCK, GROUP = 8192, 256


def _sound(v: str) -> F.Column:
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(v).isNotNull() & whole & F.exists(v, lambda x: x != 0)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """List vectors as rows of length one."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Four digits, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e4 + 0.5) / 1e4


def _rows(df: DataFrame, id_col: str, vec_col: str, extra: list[str]) -> DataFrame:
    return df.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"),
                     F.struct(*[F.col(c).alias(f"e{i}") for i, c in enumerate(extra)], F.lit(0).alias("none")).alias("_x")
                     ).filter(_sound("_v") & F.col("_id").isNotNull())


def _query_blocks(asked: DataFrame, size: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, vectors) of at most ``size`` queries; the driver holds one block at a time."""
    ids, vectors = [], []
    for r in asked.toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == size:
            yield ids, np.array(vectors)
            ids, vectors = [], []
    if ids:
        yield ids, np.array(vectors)


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) positions that may belong to a query's k best: all at or above its k-th value."""
    if sims.shape[1] > k:
        return np.nonzero(sims >= np.partition(sims, -k, axis=1)[:, -k, None])
    return np.nonzero(np.ones(sims.shape, bool))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("_sim"), "_id")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def _named(ranked: DataFrame, query_id: str, id_col: str, extra: list[str]) -> DataFrame:
    return ranked.select(F.col("_q").alias(query_id), F.col("_id").alias(id_col),
                         *[F.col(f"_x.e{i}").alias(c) for i, c in enumerate(extra)],
                         F.col("_sim").alias("similarity"), F.col("_rank").alias("rank"))


def exact_search(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                 query_id: str = "query_id", query_vec: str = "query_vec", extra: list[str] | None = None,
                 block: int = QUERY_BLOCK) -> DataFrame:
    """The k most similar rows of each query: query_id, id, extra columns, similarity, rank."""
    spark, extra = corpus.sparkSession, extra or []
    rows = _rows(corpus, id_col, vec_col, extra)
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vec).cast("array<double>").alias("_v")).filter(_sound("_v"))
    schema = T.StructType([T.StructField("_q", asked.schema["_q"].dataType), rows.schema["_id"], rows.schema["_x"],
                           T.StructField("_sim", T.DoubleType())])
    out = spark.createDataFrame([], schema).withColumn("_rank", F.lit(0)) if queries.isEmpty() else None
    for ids, vectors in _query_blocks(asked, block):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((pa.array(ids), unit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("_v"))
                    for i in range(0, len(q), 512):
                        sims = _rounded(q[i:i + 512] @ x.T)
                        a, r = _best(sims, k)
                        yield pa.RecordBatch.from_arrays(
                            [names.take(pa.array(a + i)), b.column("_id").take(pa.array(r)), b.column("_x").take(pa.array(r)),
                             pa.array(sims[a, r])], names=["_q", "_id", "_x", "_sim"])

        found = _ranked(rows.mapInArrow(run, schema), k)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], schema).withColumn("_rank", F.lit(0))
    return _named(out, query_id, id_col, extra)


# --------------------------------------------------------------------------
# the index
def lloyd(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of a bounded sample, from evenly spaced rows (the sample's order is random)."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.stack([np.bincount(near, weights=c, minlength=len(centres)) for c in x.T], axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)


@dataclass
class Books:
    """Coarse centroids (lists x dimension) and codewords (a book for each stretch of components)."""

    centroids: np.ndarray
    words: list[np.ndarray]

    @classmethod
    def learn(cls, x: np.ndarray, lists: int, sub: int, words: int) -> Books:
        centroids = lloyd(x, lists)
        rest = x - centroids[nearest(x, centroids)]
        return cls(centroids, [lloyd(rest[:, i:i + sub], words) for i in range(0, x.shape[1], sub)])

    def stretches(self) -> Iterator[tuple[slice, np.ndarray]]:
        at = 0
        for book in self.words:
            yield slice(at, at + book.shape[1]), book
            at += book.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of each vector."""
        home = nearest(x, self.centroids)
        rest = x - self.centroids[home]
        return home, np.stack([nearest(rest[:, s], book) for s, book in self.stretches()], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query with each codeword: stretch x query x word."""
        out = np.zeros((len(self.words), len(q), max(len(b) for b in self.words)), np.float32)
        for i, (s, book) in enumerate(self.stretches()):
            out[i, :, :len(book)] = q[:, s] @ book.T
        return out

    def row(self) -> tuple:
        return self.centroids.tolist(), [b.tolist() for b in self.words]


@dataclass
class VectorIndex:
    """The three written tables of an index."""

    lists: DataFrame
    vectors: DataFrame
    books: Books
    id_col: str
    extra: list[str]


BOOKS_SCHEMA = ("centroids array<array<double>>, words array<array<array<double>>>, id_col string, extra array<string>")


def build(corpus: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", extra: list[str] | None = None,
          lists: int = LISTS, sub: int = SUB, words: int = WORDS, sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex:
    """Learn the codebooks, encode every row, write the index below ``path`` and open it."""
    spark, extra = corpus.sparkSession, extra or []
    if words > 256:
        raise ValueError("a code is one byte: at most 256 codewords")
    rows = _rows(corpus, id_col, vec_col, extra)
    rows.write.parquet(f"{path}/vectors")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/vectors")
    picked = rows.select("_v", F.xxhash64("_id").alias("_h"), "_id").orderBy("_h", "_id").limit(sample).collect()   # bounded
    x = np.array([r["_v"] for r in picked]) if picked else np.ones((1, 1))
    lists = min(lists, max(1, len(x) // LEAST))
    books = Books.learn(x / np.linalg.norm(x, axis=1, keepdims=True), lists, sub, words)
    spark.createDataFrame([(*books.row(), id_col, extra)], BOOKS_SCHEMA).coalesce(1).write.parquet(f"{path}/codebooks")
    shared = spark.sparkContext.broadcast(books)
    schema = T.StructType([T.StructField("list", T.IntegerType()), rows.schema["_id"], T.StructField("code", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home, codes = shared.value.encode(_matrix(b.column("_v")))
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), b.column("_id"), pa.array(map(bytes, codes), pa.binary())],
                                                 names=["list", "_id", "code"])

    coded = rows.select("_id", "_v").mapInArrow(encode, schema)
    # a list of n rows has n / block parts by id hash: groups of bounded size, however large the list
    coded.write.parquet(f"{path}/coded")
    coded = spark.read.schema(schema).parquet(f"{path}/coded")
    size = coded.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))   # one row a list
    parts = coded.join(size, "list").withColumn("block", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    packed = parts.groupBy("list", "block").agg(F.sort_array(F.collect_list(F.struct("_id", "code"))).alias("r"))
    packed.select("list", "block", F.col("r._id").alias("ids"), F.col("r.code").alias("codes")).write.parquet(f"{path}/lists")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    centroids, words, id_col, extra = spark.read.parquet(f"{path}/codebooks").first()
    return VectorIndex(spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/vectors"),
                       Books(np.array(centroids), [np.array(w) for w in words]), id_col, list(extra))


def probes(index: VectorIndex, queries: DataFrame, query_id: str, query_vec: str, probed: int) -> DataFrame:
    """(_q, _v, list): the nearest lists of each query."""
    asked = queries.select(F.col(query_id).alias("_q"), F.col(query_vec).cast("array<double>").alias("_v")).filter(_sound("_v"))
    shared = queries.sparkSession.sparkContext.broadcast(index.books.centroids)
    schema = T.StructType([*asked.schema.fields, T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sims = _matrix(b.column("_v")) @ shared.value.T
                at = np.argsort(-sims, axis=1, kind="stable")[:, :probed]
                again = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("_q").take(again), b.column("_v").take(again),
                                                  pa.array(at.ravel(), pa.int32())], names=["_q", "_v", "list"])

    return asked.mapInArrow(run, schema)


def candidates(index: VectorIndex, queries: DataFrame, query_id: str, query_vec: str, probed: int, rerank: int,
               group: int = GROUP) -> DataFrame:
    """(_q, _v, _id, _near): the ``rerank`` best rows of each query by asymmetric distance."""
    near = probes(index, queries, query_id, query_vec, probed)
    n = queries.count()
    groups = (near.withColumn("g", F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-n // group)))))
              .groupBy("list", "g").agg(F.collect_list(F.struct("_q", "_v")).alias("asked")))   # about ``group`` queries each
    pairs = groups.join(index.lists, "list").select("list", F.col("asked._q").alias("qs"), F.col("asked._v").alias("vs"), "ids", "codes")
    shared = queries.sparkSession.sparkContext.broadcast(index.books)
    schema = T.StructType([T.StructField("_q", near.schema["_q"].dataType), near.schema["_v"],
                           T.StructField("_id", index.vectors.schema["_id"].dataType),
                           T.StructField("_near", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            for i in range(b.num_rows):
                qs, vs, ids = (b.column(c)[i].values for c in ("qs", "vs", "ids"))
                codes = np.frombuffer(b"".join(b.column("codes")[i].values.to_pylist()), np.uint8).reshape(len(ids), -1)
                q = _matrix(vs)
                sims = np.repeat((q @ books.centroids[b.column("list")[i].as_py()])[:, None].astype(np.float32), len(ids), axis=1)
                for table, code in zip(books.tables(q), codes.T, strict=True):
                    sims += table[:, code]
                a, r = _best(sims, rerank)
                yield pa.RecordBatch.from_arrays(
                    [qs.take(pa.array(a)), vs.take(pa.array(a)), ids.take(pa.array(r)), pa.array(sims[a, r].astype(np.float64))],
                    names=["_q", "_v", "_id", "_near"])

    order = Window.partitionBy("_q").orderBy(F.desc("_near"), "_id")
    return pairs.mapInArrow(run, schema).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rerank)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_vec: str = "query_vec",
           probed: int | None = None, rerank: int = RERANK) -> DataFrame:
    """The k most similar rows of each query among its candidates (columns as ``exact_search``)."""
    probed = probed or max(1, round(PROBED * len(index.books.centroids)))
    found = candidates(index, queries, query_id, query_vec, probed, rerank).select("_q", F.col("_v").alias("_qv"), "_id")
    rows = index.vectors.withColumnRenamed("_v", "_w")
    sims = found.join(rows, "_id").withColumn("_sim", F.round(cosine_similarity("_qv", "_w"), 4))
    return _named(_ranked(sims, k), query_id, index.id_col, index.extra)


def recall(exact: DataFrame, approximate: DataFrame, query_id: str = "query_id", id_col: str = "vec_id") -> DataFrame:
    """One row: queries, wanted (rows of the exact result), found (those the other has too), recall (4 digits, 1 without rows)."""
    has = approximate.select(query_id, id_col).withColumn("_hit", F.lit(1))
    n = exact.select(query_id, id_col).join(has, [query_id, id_col], "left").agg(
        F.countDistinct(query_id).alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found"))
    return n.withColumn("recall", F.coalesce(F.round(F.try_divide("found", "wanted"), 4), F.lit(1.0)))


def index_and_search(corpus: DataFrame, queries: DataFrame, k: int = 5, **kw) -> DataFrame:
    """Build an index in the scratch folder and search it."""
    return search(build(corpus, scratch_dir(corpus.sparkSession, "vector-index"), **kw), queries, k)
