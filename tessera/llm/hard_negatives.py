"""Operator 13: hard negatives by exact integer scores.

Vectors are scaled to whole numbers; the score of two rows is their inner product. The
anchors are the stated query set. They go to the tasks in blocks of at most
``ANCHOR_BLOCK`` rows, and every block is compared with all rows in two narrow passes,
each over tiles of anchors x candidates whose products come from Strassen's recursion
(seven half-size products instead of eight, zero padding at odd sizes):

* first the best ``n_positives`` other rows of the anchor's own label,
* then, as the windows are known, the best ``n_negatives`` rows of another label with
  ``low * positive <= 100 * negative <= high * positive`` for each positive.

A task keeps what it found in mergeable heaps (``Heaps``): the k best entries of each
slot, so that heaps of tiles, then of tasks, merge to the same result in any order. A
task sends at most k entries a slot; the last merge is a ranked window per slot. No pair
of rows is ever written, and no task holds more than one tile, one block and its heaps.

Exactness: the recursion only adds, subtracts and multiplies 64-bit integers, which wrap
around, so intermediate overflow cancels out and results are right whenever the final
scores fit 64 bits. Tables in which they might not (dimension x largest square) are
refused with a ValueError.

Defined results: rows with a null label, a null vector or a null or non-finite component
take no part; a row without id is no anchor and comes after all ids in ties; vectors of
different length are compared as if zeros followed the shorter; rows with one id are rows
of their own (equal ones tie in no order that shows); an anchor without positives, a
window without rows and an empty table give no rows; other columns are not read, so
clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut, shared_dir, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies within these percentages of its positive's.
LOW, HIGH = 30, 90
#: Anchors a pass (64 dimensions: 2 MB of broadcast); anchors and candidates of one product.
ANCHOR_BLOCK, ANCHOR_TILE, CANDIDATE_TILE = 4096, 256, 2048
#: Sizes at which the recursion ends.
LEAF = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exact modulo 2^64 (both row-major, one vector a row)."""
    p, q, r = a.shape[0], a.shape[1], b.shape[0]
    if min(p, q, r) <= leaf:
        return a @ b.T
    if p % 2 or q % 2:
        a = np.pad(a, ((0, p % 2), (0, q % 2)))
    if r % 2 or q % 2:
        b = np.pad(b, ((0, r % 2), (0, q % 2)))
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[0] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b21, b12, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]   # blocks of the transpose
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * j), np.int64)
    c[:i, :j] = m1 + m4 - m5 + m7
    c[:i, j:] = m3 + m5
    c[i:, :j] = m2 + m4
    c[i:, j:] = m1 - m2 + m3 + m6
    return c[:p, :r]


class Heaps:
    """The ``k`` best entries of each slot: higher scores first, then smaller ids (none last).

    Pushing and merging commute, so tiles and tasks may come in any order.
    """

    FIELDS = ("slot", "score", "void", "id", "row")

    def __init__(self, k: int):
        self.k = k
        self.columns = [np.empty(0, np.int64) for _ in self.FIELDS]

    def push(self, *columns: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in zip(self.columns, columns, strict=True)]
        slot, score, void, key, row = merged
        order = np.lexsort((row, key, void, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        order = order[rank < self.k]
        self.columns = [x[order] for x in merged]

    @classmethod
    def merged(cls, k: int, parts: list[Heaps]) -> Heaps:
        out = cls(k)
        out.push(*[np.concatenate([p.columns[i] for p in parts] or [out.columns[i]]) for i in range(len(cls.FIELDS))])
        return out


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of ``width`` whole numbers, zeros at the end of shorter ones."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Candidates:
    """Columns of a batch of rows, in tiles."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.row = batch.column(0).to_numpy()
        ids = batch.column(1)
        self.void = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.id = ids.fill_null(0).to_numpy()
        self.label = batch.column(2).to_numpy()
        self.vector = matrix(batch.column(3), width)

    def tiles(self, at: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(at), CANDIDATE_TILE):
            yield at[i:i + CANDIDATE_TILE]


def find_positives(block: dict, c: Candidates, heaps: dict, k: int) -> None:
    """Push the rows of ``c`` that carry an anchor's label, the anchor itself not (a heap for each tile of anchors)."""
    for label in np.unique(block["label"]):
        same = np.flatnonzero(block["label"] == label)
        for at in c.tiles(np.flatnonzero(c.label == label)):
            for i in range(0, len(same), ANCHOR_TILE):
                anchors = same[i:i + ANCHOR_TILE]
                score = strassen(block["vector"][anchors], c.vector[at])
                other = block["row"][anchors][:, None] != c.row[at]
                keep = other
                if len(at) > k + 1:   # what lies below the k + 1st best score cannot be in the heap
                    keep = other & (score >= np.partition(score, -k - 1, axis=1)[:, -k - 1, None])
                x, y = np.nonzero(keep)
                z = at[y]
                heaps.setdefault((label, i), Heaps(k)).push(anchors[x], score[x, y], c.void[z], c.id[z], c.row[z])


def find_negatives(block: dict, c: Candidates, heaps: dict, k: int) -> None:
    """Push the rows of ``c`` of another label that lie in an anchor's windows (slot: anchor * windows + window)."""
    low, high = block["low"], block["high"]
    n = low.shape[1]
    widest_low, widest_high = low.min(axis=1), high.max(axis=1)
    for at in c.tiles(np.arange(len(c.row))):
        for i in range(0, len(block["row"]), ANCHOR_TILE):
            s = slice(i, i + ANCHOR_TILE)
            score = strassen(block["vector"][s], c.vector[at])
            x, y = np.nonzero((score >= widest_low[s, None]) & (score <= widest_high[s, None])
                              & (block["label"][s, None] != c.label[at]))
            score, x, z = score[x, y], x + i, at[y]
            entry, w = np.nonzero((score[:, None] >= low[x]) & (score[:, None] <= high[x]))
            z = z[entry]
            heaps.setdefault(i, Heaps(k)).push(x[entry] * n + w, score[entry], c.void[z], c.id[z], c.row[z])


def compare(rows: DataFrame, block: dict, find, k: int) -> DataFrame:
    """The k best entries a slot over all rows: slot, score, id, row, rank."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, b = {}, shared.value
        for batch in batches:
            if batch.num_rows:
                find(b, Candidates(batch, b["vector"].shape[1]), heaps, k)
        slot, score, void, key, row = Heaps.merged(k, list(heaps.values())).columns
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(score), pa.array(key, mask=void.astype(bool)), pa.array(row)],
            names=["slot", "score", "id", "row"])

    found = rows.mapInArrow(run, "slot long, score long, id long, row long")
    best = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def prepare(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """The rows that take part, written once: row (unique), id, label, vector (whole numbers), anchor."""
    x = df.select(df[key].cast("long").alias("id"), label.cast("long").alias("label"), df[vector].alias("v"),
                  F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x = x.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & sound)
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return cut(x.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("vector"),
                        (F.col("anchor") & F.col("id").isNotNull()).alias("anchor")), "vectors")


def checked_width(rows: DataFrame) -> int:
    """The largest dimension; raises where a score might not fit 64 bits."""
    d, high, low = rows.agg(F.max(F.size("vector")), F.max(F.array_max("vector")), F.min(F.array_min("vector"))).first()
    if d and high is not None and d * max(high, -low) ** 2 >= 1 << 63:
        raise ValueError("components are too large for 64-bit scores; lower the scale")
    return d or 0


def anchor_blocks(rows: DataFrame, width: int, size: int) -> Iterator[dict]:
    """The anchors in blocks of at most ``size`` rows; the driver holds one block at a time."""
    def packed(part: list) -> dict:
        vectors = np.zeros((len(part), width), np.int64)
        for i, r in enumerate(part):
            vectors[i, :len(r.vector)] = r.vector
        return {"row": np.array([r.row for r in part], np.int64), "id": np.array([r.id for r in part], np.int64),
                "label": np.array([r.label for r in part], np.int64), "vector": vectors}

    part = []
    for r in rows.filter("anchor").select("row", "id", "label", "vector").toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield packed(part)
            part = []
    if part:
        yield packed(part)


def mine(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, n_positives: int = POSITIVES,
         n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
         block: int = ANCHOR_BLOCK) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
              "positive_rank int")
    rows = prepare(df, key, vector, label, anchor, scale)
    width, folder = checked_width(rows), shared_dir(spark, "negatives")
    everything = rows.select("row", "id", "label", "vector")
    done = 0
    for done, anchors in enumerate(anchor_blocks(rows, width, block), 1):
        n = len(anchors["row"])
        positives = compare(everything, anchors, find_positives, n_positives).collect()
        lows, highs = np.ones((n, n_positives), np.int64), np.zeros((n, n_positives), np.int64)   # an empty window
        for p in positives:
            lows[p.slot, p.rank - 1], highs[p.slot, p.rank - 1] = -(-low * p.score // 100), high * p.score // 100
        windows = {**anchors, "low": lows, "high": highs}
        negatives = compare(everything, windows, find_negatives, n_negatives)
        named = spark.createDataFrame(
            [(p.slot * n_positives + p.rank - 1, int(anchors["id"][p.slot]), p.id, p.score, p.rank) for p in positives],
            "slot long, anchor_id long, positive_id long, positive_score long, positive_rank int")
        out = negatives.join(F.broadcast(named), "slot")   # at most a block's anchors x positives
        out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                   F.col("score").alias("negative_score"), "positive_rank").write.parquet(f"{folder}/block={done}")
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/block={i}" for i in range(1, done + 1)])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(e.vec_id % 7 == 0, (e.label + 1) % 10).otherwise(e.label)
    return mine(e, "vec_id", "embedding", label, e.vec_id % 100 == 0).drop("positive_rank")


ORACLE_SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, e.r, e.vec_id, a.label = e.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.r <> e.r),
p AS (
  SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (ar, anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY ar, pr ORDER BY score DESC, vec_id, r)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
