"""Rows scored by a fitted forest, a cell at a time.

Rows between the same thresholds of the forest, a cell, go the same way in every tree. A task
finds the cell of each row by its values, walks the trees once a cell and looks the other rows up.
Nothing is shuffled; the nodes (bounded by the model) go to the tasks as a broadcast. Votes are added
up in the order of the trees, as MLlib does, so scores equal those of MLlib's ``transform``.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_dir

#: Numbers in the votes of all nodes up to which a forest goes to the tasks.
VOTES = 8_000_000
#: Cells up to which a task keeps a place for each; above, the cells of a batch are scored.
PLACES = 1 << 22
#: Cells walked at a time.
ROWS = 4096
_FORESTS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


@dataclass
class Nodes:
    """The trees one after another. A row goes left where low < code <= high for its code, the number of
    ``bounds`` of the feature below its value; leaves lead to themselves."""

    bounds: list[np.ndarray]
    roots: np.ndarray
    depths: list[int]
    feature: np.ndarray
    low: np.ndarray | None
    high: np.ndarray
    child: np.ndarray
    votes: np.ndarray
    shares: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row a row; NaN, which goes right everywhere, lies above all bounds."""
        return np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(self.bounds)], axis=1).astype(np.int64)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.votes.shape[1]))
        for lo in range(0, len(codes), ROWS):
            c = codes[lo:lo + ROWS]
            flat, base, total = c.ravel(), np.arange(len(c)) * c.shape[1], out[lo:lo + ROWS]
            for root, depth in zip(self.roots, self.depths):
                at = np.full(len(c), root)
                for _ in range(depth):
                    code = flat[base + self.feature[at]]
                    right = code > self.high[at]
                    if self.low is not None:
                        right |= code <= self.low[at]
                    at = self.child[2 * at + right]
                total += self.votes[at]
        return out / self.shares


def _nodes(t: pa.Table, classes: int | None, features: int) -> Nodes | None:
    """None where a split lists several categories, which is no interval of values."""
    c = {k: t.column(k).to_numpy() for k in ("tree", "id", "left", "right", "feature", "at", "levels", "prediction")}
    order = np.lexsort((c["id"], c["tree"]))
    c = {k: v[order] for k, v in c.items()}
    inner, listed = c["left"] >= 0, c["levels"] >= 0
    if (c["levels"] > 2).any():
        return None
    roots = np.flatnonzero(c["id"] == 0)
    start = roots[np.cumsum(c["id"] == 0) - 1]
    own = np.arange(len(order))
    child = np.stack([np.where(inner, start + c["left"], own), np.where(inner, start + c["right"], own)], axis=1)
    # a category is the values above the next lower number, up to itself
    below = np.nextafter(c["at"], -np.inf)
    low, high, bounds = np.full(len(order), -1), np.full(len(order), np.iinfo(np.int64).max), []
    for f in range(features):
        of = inner & (c["feature"] == f)
        b = np.unique(np.concatenate([c["at"][of], below[of & listed]]))
        high[of] = np.searchsorted(b, c["at"][of], "left")
        low[of & listed] = np.searchsorted(b, below[of & listed], "left")
        bounds.append(b)
    depth = np.zeros(len(order), np.int64)
    for i in np.flatnonzero(inner):      # parents come first
        depth[child[i]] = depth[i] + 1
    depths = np.maximum.reduceat(depth, roots).tolist()
    if classes:
        stats = t.column("stats").combine_chunks().flatten().to_numpy().reshape(len(order), classes)[order]
        total = stats.cumsum(1)[:, -1:]
        votes = np.divide(stats, total, out=np.zeros(stats.shape), where=total != 0)
    else:
        votes = c["prediction"][:, None]
    return Nodes(bounds, roots, depths, np.where(inner, c["feature"], 0), low if listed[inner].any() else None, high, child.ravel(), votes,
                 1 if classes else len(roots))


def _known(spark: SparkSession, forest, classes: int | None):
    """The broadcast nodes, or None; kept as long as the forest."""
    sc = spark.sparkContext
    if forest not in _FORESTS or _FORESTS[forest][0] is not sc:
        path = getattr(forest, "saved_at", None)
        if path is None:
            path = scratch_dir(spark, "forest")
            forest.write().overwrite().save(path)
        fields = {"treeID": "tree", "nodeData.id": "id", "nodeData.leftChild": "left", "nodeData.rightChild": "right",
                  "nodeData.split.featureIndex": "feature", "nodeData.split.numCategories": "levels", "nodeData.prediction": "prediction",
                  "nodeData.impurityStats": "stats"}
        at = F.coalesce(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0)).alias("at")
        t = spark.read.parquet(f"{path}/data").select(*[F.col(k).alias(v) for k, v in fields.items()], at).toArrow()
        nodes = _nodes(t, classes, forest.numFeatures)
        _FORESTS[forest] = (sc, sc.broadcast(nodes) if nodes else None)
    return _FORESTS[forest][1]


def forest_votes(spark: SparkSession, forest, x: Column) -> Column | None:
    """The votes for each class, or the prediction of a regression, as an array; ``x``: the features as an array
    without nulls. None where the model is no forest, too large for a task or has lists of categories."""
    if not isinstance(forest, (RandomForestClassificationModel, RandomForestRegressionModel)):
        return None
    classes = forest.numClasses if isinstance(forest, RandomForestClassificationModel) else None
    if forest.totalNumNodes * (classes or 1) > VOTES:
        return None
    shared = _known(spark, forest, classes)
    if shared is None:
        return None

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        nodes = shared.value
        radix = [len(b) + 1 for b in nodes.bounds]
        cells = int(np.prod(np.array(radix, object)))
        place, found, n = None, np.empty((0, nodes.votes.shape[1])), 0
        for b in batches:
            x = b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), len(radix))
            codes = nodes.codes(x)
            if cells > PLACES:
                seen, back = np.unique(codes, axis=0, return_inverse=True)
                out = nodes.scores(seen)[back.ravel()]
            else:
                if place is None:
                    place = np.full(cells, -1, np.int32)
                key = np.zeros(len(b), np.int64)
                for f, r in enumerate(radix):
                    key = key * r + codes[:, f]
                new, first = np.unique(key[place[key] < 0], return_index=True)
                if len(new):
                    if n + len(new) > len(found):
                        found = np.concatenate([found, np.empty((max(n, len(new)), found.shape[1]))])
                    found[n:n + len(new)] = nodes.scores(codes[np.flatnonzero(place[key] < 0)[first]])
                    place[new] = np.arange(n, n + len(new))
                    n += len(new)
                out = found[place[key]]
            size = np.arange(len(b) + 1, dtype=np.int32) * out.shape[1]
            yield pa.ListArray.from_arrays(pa.array(size), pa.array(out.ravel()))
    return F.arrow_udf(run, "array<double>")(x)
