"""Why did the model say this: Shapley attributions of single predictions of a forest.

The attribution of a feature is its Shapley value in the game whose value for a set of known
features is the forest's expected output when the splits on the others are followed by the
training rows' shares (path-dependent expectations). Attributions of a row add up to its
prediction minus the forest's mean output (``base``).

A leaf pays its value times a product over the d features on its path: 1 or 0 for a known
feature (the row passes the leaf's splits on it, or not), the share of training rows for an
unknown one. So a leaf's Shapley values depend on the row through d bits only. For the leaves
of a tree that have the same d they are computed once for all 2^d bit patterns (d coefficients
of a polynomial each), and rows look them up; above ``PATTERNS`` features on a path they are
computed for the patterns that occur.

The nodes come from the fitted model's own table (bounded by the model, not the data) and go to
the tasks as a broadcast. Rows between the same thresholds of the forest, a cell, have the same
attributions: they are computed once a cell in Arrow batches and joined to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ml import align_features
from tessera.session import scratch_dir

#: Features on a path up to which all bit patterns are tabulated.
PATTERNS = 9
#: Rows looked up at a time.
ROWS = 512


@dataclass
class Leaves:
    """Leaves of one tree with the same number of features on their path: for each leaf and
    feature the interval (low, high] that leads to it and the share of rows that take it."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def shapley(share: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Shapley values of the product game: feature j is worth known_j inside a set, share_j outside
    (last axis: features; the others broadcast)."""
    d = share.shape[-1]
    share, known = np.broadcast_arrays(share, known)
    # coefficients of prod_j (share_j + known_j x): sets by their size
    c = np.zeros((*share.shape[:-1], d + 1))
    c[..., 0] = 1.0
    for j in range(d):
        c[..., 1:] = c[..., 1:] * share[..., j, None] + c[..., :-1] * known[..., j, None]
        c[..., 0] *= share[..., j]
    weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
    out = np.empty(share.shape)
    for j in range(d):
        s, on = share[..., j], known[..., j] > 0
        # the polynomial without feature j: division by (s + x), or by s where j is 0
        total, rest = np.zeros(s.shape), np.zeros(s.shape)
        for k in range(d - 1, -1, -1):
            rest = np.where(on, c[..., k + 1] - s * rest, c[..., k] / s)
            total += weight[k] * rest
        out[..., j] = (known[..., j] - s) * total
    return out


def forest_nodes(spark: SparkSession, forest) -> DataFrame:
    """tree, id, left, right, feature, at (threshold or left categories), levels, stats: the model's own table."""
    path = scratch_dir(spark, "forest")
    forest.write().overwrite().save(path)
    fields = {"treeID": "tree", "nodeData.id": "id", "nodeData.leftChild": "left", "nodeData.rightChild": "right",
              "nodeData.split.featureIndex": "feature", "nodeData.split.leftCategoriesOrThreshold": "at",
              "nodeData.split.numCategories": "levels", "nodeData.impurityStats": "stats"}
    return spark.read.parquet(f"{path}/data").select(*[F.col(c).alias(name) for c, name in fields.items()])


def tree_leaves(nodes: dict, value, cover) -> list[tuple[dict, float]]:
    """(feature -> (low, high, share), value) of each leaf."""
    found, stack = [], [(0, {})]
    while stack:
        at, path = stack.pop()
        node = nodes[at]
        if node["left"] < 0:
            found.append((path, value(node["stats"])))
            continue
        cut = node["at"][0]
        sides = [(node["left"], True), (node["right"], False)]
        if node["levels"] >= 0:
            if node["levels"] > 2:
                raise ValueError("splits on more than two categories have no interval form")
            if cut > 0.5:   # category 1 goes left
                sides = [(node["right"], True), (node["left"], False)]
            cut = 0.5
        low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
        for child, below in sides:
            part = share * cover(nodes[child]["stats"]) / cover(node["stats"])
            bounds = (low, min(high, cut), part) if below else (max(low, cut), high, part)
            stack.append((child, {**path, node["feature"]: bounds}))
    return found


def forest_leaves(spark: SparkSession, forest, label: int | None) -> tuple[list[Leaves], float]:
    """The forest's leaves, values divided by the number of trees, and its mean output.

    ``label``: the class whose probability is explained, None for a regression."""
    if label is None:
        value, cover = (lambda s: s[1] / s[0]), (lambda s: s[0])
    else:
        value, cover = (lambda s: s[label] / sum(s)), sum
    trees: dict[int, dict] = {}
    for r in forest_nodes(spark, forest).collect():   # the model's nodes
        trees.setdefault(r["tree"], {})[r["id"]] = r
    groups, base = [], 0.0
    for nodes in trees.values():
        by_size: dict[int, list] = {}
        for path, v in tree_leaves(nodes, value, cover):
            v /= len(trees)
            base += v * float(np.prod([p[2] for p in path.values()]))
            if path:
                by_size.setdefault(len(path), []).append((path, v))
        for leaves in by_size.values():
            box = np.array([[p[f] for f in p] for p, _ in leaves])
            groups.append(Leaves(np.array([list(p) for p, _ in leaves]), box[..., 0], box[..., 1], box[..., 2],
                                 np.array([v for _, v in leaves])))
    return groups, base


def attribute(x: np.ndarray, groups: list[Leaves]) -> np.ndarray:
    """Shapley values of the rows of ``x`` (rows x features)."""
    out = np.zeros(x.shape)
    for g in groups:
        n, d = g.feature.shape
        if d <= PATTERNS:
            patterns = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
            table = shapley(g.share[:, None, :], patterns[None]) * g.value[:, None, None]
        for i in range(0, len(x), ROWS):
            part = x[i:i + ROWS]
            bits = np.zeros((len(part), n), np.int64)
            for j in range(d):
                v = part[:, g.feature[:, j]]
                bits |= ((v > g.low[:, j]) & (v <= g.high[:, j])).astype(np.int64) << j
            for j in range(d):
                if d <= PATTERNS:
                    paid = table[np.arange(n), bits, j]
                    # leaves with the same j-th feature add up
                    for f in np.unique(g.feature[:, j]):
                        out[i:i + ROWS, f] += paid[:, g.feature[:, j] == f].sum(axis=1)
            if d > PATTERNS:
                for leaf in range(n):
                    seen, back = np.unique(bits[:, leaf], return_inverse=True)
                    known = (seen[:, None] >> np.arange(d) & 1).astype(float)
                    out[i:i + ROWS, g.feature[leaf]] += (shapley(g.share[leaf], known) * g.value[leaf])[back]
    return out


def forest_cells(groups: list[Leaves], features: int) -> list[np.ndarray]:
    """The bounds of the leaves by feature; values with the same ones below them reach the same leaves."""
    edges = []
    for f in range(features):
        bounds = [b[g.feature == f] for g in groups for b in (g.low, g.high)]
        edges.append(np.unique(np.concatenate([[-np.inf], *bounds])))
    return edges


def cell_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The number of bounds below each value; NaN, which no interval holds, has one of its own."""
    cell = np.empty(x.shape, np.int32)
    for f, e in enumerate(edges):
        cell[:, f] = np.where(np.isnan(x[:, f]), -1, np.searchsorted(e, x[:, f], "left"))
    return cell


def attributions(model: PipelineModel, df: DataFrame, features: list[str], keep: list[str],
                 label: str | None = None) -> DataFrame:
    """keep..., base, prediction, feature, value, attribution: a row for each row and feature.

    ``prediction`` is the model's probability of ``label`` (the last class if not given), or a
    regression's output. Features are taken by name as in ``predict_batch``: missing ones and
    nulls are 0."""
    spark, forest = df.sparkSession, model.stages[-1]
    at = None
    if hasattr(forest, "numClasses"):
        labels = list(model.stages[0].labels)
        at = labels.index(label) if label is not None else len(labels) - 1
    groups, base = forest_leaves(spark, forest, at)
    shared = spark.sparkContext.broadcast(groups)
    # the kept columns travel in a struct: a name may be a feature's too
    kept = F.struct(*[F.col(k) for k in keep], F.lit(0).alias("_none")).alias("_kept")
    rows = align_features(df.select("*", kept), features, ["_kept"])
    rows = rows.select("_kept", F.array(*[F.col(f"`{f}`") for f in features]).alias("_x"))
    edges = forest_cells(groups, len(features))

    def values(b: pa.RecordBatch) -> np.ndarray:
        return b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = [c.tobytes() for c in cell_of(values(b), edges)]
                yield pa.RecordBatch.from_arrays([b.column("_kept"), b.column("_x"), pa.array(keys, pa.binary())], names=["_kept", "_x", "_cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = attribute(values(b), shared.value)
                size = np.arange(b.num_rows + 1, dtype=np.int32) * found.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column("_cell"), pa.ListArray.from_arrays(pa.array(size), pa.array(found.ravel()))], names=["_cell", "_a"])

    celled = rows.mapInArrow(cells, T.StructType([rows.schema["_kept"], rows.schema["_x"], T.StructField("_cell", T.BinaryType())]))
    # few but costly rows: as many parts as tasks can run, which AQE would make one
    each = celled.groupBy("_cell").agg(F.first("_x").alias("_x")).repartition(spark.sparkContext.defaultParallelism, "_cell")
    scored = celled.join(each.mapInArrow(run, "_cell binary, _a array<double>"), "_cell")
    names = F.array(*[F.lit(f) for f in features])
    total = F.aggregate("_a", F.lit(0.0), lambda s, v: s + v) + F.lit(base)
    out = scored.select("_kept", total.alias("prediction"), F.inline(F.arrays_zip(
        names.alias("feature"), F.col("_x").alias("value"), F.col("_a").alias("attribution"))))
    return out.select(*[F.col(f"_kept.`{k}`") for k in keep], F.lit(base).alias("base"), "prediction", "feature", "value", "attribution")


def attribution_summary(explained: DataFrame) -> DataFrame:
    """feature, mean_abs (mean size of its attributions), mean (their mean), rows."""
    return explained.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean"),
                                            F.count(F.lit(1)).alias("rows"))
