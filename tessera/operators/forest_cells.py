"""Forests of many rows grown on cells.

A forest sees a row only through the bins of its features (32 a feature). Rows with the same
bins, a cell, stay together in every tree, so a tree needs no more of a cell than how often the
bootstrap drew its rows and, in a regression, the sums of the drawn values and of their squares.
The bootstrap is drawn row by row as before: Poisson(1) a row and tree, for the n rows of a cell
and class together Poisson(n), which is the same. The trees are grown in tasks of a few trees each
(``grow_tree``, by MLlib's rules), which have all cells: their number depends on the bins and not
on the rows. The nodes are written as MLlib saves them and loaded as one of its forests, with
thresholds between the values of the rows.

Draws are seeded by cell and label, so a rerun draws the same whatever the partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_dir

BINS = 32
#: Rows from which a forest is grown on cells, and the most cells.
ROWS, CELLS = 50_000, 200_000
#: Features up to which cells are tried.
FEATURES = 64
#: Rows of a cell that one task draws.
GROUP = 1_000_000
#: Trees that one task grows at a time.
TOGETHER = 4


def feature_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between the bins of a feature, as MLlib places them: between all values if
    there are no more than bins, otherwise at their quantiles."""
    found, n = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(found) <= bins:
        return between
    stride, seen = n.sum() / bins, np.cumsum(n)
    target, edges = stride, []
    for i in range(1, len(found)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            edges.append(between[i - 1])
            target += stride
    return np.array(edges)


def _binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(cell, y): a byte a feature, the number of thresholds below its value (NaN: all of them)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cell = np.empty(x.shape, np.uint8)
            for j, e in enumerate(edges):
                cell[:, j] = np.searchsorted(e, x[:, j], "left")
            size = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1]).buffers()[1]
            cells = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, size, pa.py_buffer(cell.tobytes())])
            yield pa.RecordBatch.from_arrays([cells, b.column("y")], names=["cell", "y"])
    return rows.mapInArrow(run, "cell binary, y double")


def _drawn_classes(counted: DataFrame, trees: int, seed: int) -> DataFrame:
    """(cell, y, s): how often the bootstrap of each tree draws the rows of a cell and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.random.default_rng([h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]).poisson(n, trees).astype(float)
                 for n, h in zip(b.column("n").to_pylist(), b.column("h").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("y"), pa.array(s, pa.list_(pa.float64()))], names=["cell", "y", "s"])
    h = F.xxhash64(F.lit(seed), "cell", "y")
    rows = counted.repartition(counted.sparkSession.sparkContext.defaultParallelism, "cell")
    return rows.select("cell", "y", "n", h.alias("h")).mapInArrow(run, "cell binary, y double, s array<double>")


def _drawn_values(binned: DataFrame, trees: int, seed: int, parts: int) -> DataFrame:
    """(cell, s): of the rows that each tree's bootstrap draws the number, sum and sum of squares, one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rng, total = None, None, None
        for b in batches:
            cells, part = b.column("cell").to_pylist(), b.column("part").to_numpy()
            y, h = b.column("y").to_numpy(), b.column("h").to_numpy()
            keys = list(zip(cells, part.tolist()))
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)] if keys else []
            done = []
            for lo, hi in zip(starts, starts[1:]):
                if keys[lo] != at:
                    if at is not None:
                        done.append((at[0], total))
                    at, total = keys[lo], np.zeros(3 * trees)
                    rng = np.random.default_rng([int(h[lo]) & 0xFFFFFFFF, int(h[lo]) >> 32 & 0xFFFFFFFF])
                for i in range(lo, hi, 512):
                    v = y[i:min(i + 512, hi)]
                    # Poisson(rows * trees) draws spread evenly are Poisson(1) for each row and tree
                    size = len(v) * trees
                    drawn = np.bincount(rng.integers(0, size, rng.poisson(size)), minlength=size).reshape(len(v), trees)
                    total += (np.stack([np.ones(len(v)), v, v * v]) @ drawn.astype(float)).ravel()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.binary()),
                                                  pa.array([t for _, t in done], pa.list_(pa.float64()))], names=["cell", "s"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.binary()), pa.array([total], pa.list_(pa.float64()))], names=["cell", "s"])
    rows = binned.withColumn("part", F.pmod(F.xxhash64("y"), F.lit(parts)).cast("int")).withColumn("h", F.xxhash64(F.lit(seed), "cell", "part"))
    # costly rows: enough parts for all cores, which AQE would make a few
    n = max(3 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = rows.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "y").mapInArrow(run, "cell binary, s array<double>")
    if parts == 1:
        return drawn
    sums = drawn.select("cell", F.posexplode("s").alias("i", "v")).groupBy("cell", "i").agg(F.sum("v").alias("v"))
    return sums.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("s"))


def _gains(left: np.ndarray, right: np.ndarray, classes: bool) -> np.ndarray:
    """What splits lower the impurity by; statistics of the two sides on the first axis. No gain where a side has no row."""
    l, r = (left.sum(0), right.sum(0)) if classes else (left[0], right[0])
    n = l + r
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = _impurity(left + right, classes) - l / n * _impurity(left, classes) - r / n * _impurity(right, classes)
    return np.where((l >= 1) & (r >= 1), gain, -np.inf)


def _impurity(s: np.ndarray, classes: bool) -> np.ndarray:
    """Gini of class counts, or the variance of (number, sum, sum of squares); statistics on the first axis."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            return 1.0 - ((s / s.sum(0)) ** 2).sum(0)
        return (s[2] - s[1] * s[1] / s[0]) / s[0]


def _added(keys: np.ndarray, stats: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(keys, v, size) for v in stats])


def grow_tree(codes: np.ndarray, stats: np.ndarray, bins: list[int], classes: bool, depth: int, subset: int, rng: np.random.Generator,
              memory_mb: int = 256) -> dict:
    """One tree as MLlib grows it: level by level, each node split where the impurity falls most,
    among ``subset`` features drawn for the node; leaves that agree are pruned.

    ``codes``: a row a feature, a column a cell; ``stats``: what the tree has of each cell (a row a
    class, or number, sum and sum of squares); ``memory_mb``: for the statistics of the nodes that are
    split side by side. Returns the columns of the nodes, parents before children."""
    there = (stats.sum(0) if classes else stats[0]) > 0
    codes, stats = codes[:, there], stats[:, there]
    features = [f for f, b in enumerate(bins) if b > 1]
    block = max(1, (memory_mb << 20) // (8 * 6 * max(bins) * len(stats)))
    total = stats.sum(1, keepdims=True)
    # of all nodes: statistics, gain, feature, bin and left child (the right one is next)
    levels = [[total, np.full(1, -1.0), np.full(1, -1), np.full(1, -1), np.full(1, -1)]]
    nodes, node, active = 1, np.zeros(codes.shape[1], np.int64), np.zeros(1, np.int64)     # active: places in the last level
    for level in range(depth):
        m = len(active)
        if not m or not features:
            break
        best, feature, cut = np.full(m, -np.inf), np.full(m, -1), np.full(m, -1)
        if subset < len(bins):
            chosen = np.zeros((m, len(bins)), bool)
            np.put_along_axis(chosen, rng.random((m, len(bins))).argpartition(subset - 1, axis=1)[:, :subset], True, axis=1)
        for f, lo in itertools.product(features, range(0, m, block)):
            at = np.arange(lo, min(lo + block, m))
            if subset < len(bins):
                at = at[chosen[at, f]]
            if not len(at):
                continue
            if len(at) == m:
                keys, some = node * bins[f] + codes[f], stats
            else:
                place = np.full(m, -1)
                place[at] = np.arange(len(at))
                place = place[node]
                rows = np.flatnonzero(place >= 0)
                keys, some = place[rows] * bins[f] + codes[f, rows], stats[:, rows]
            h = _added(keys, some, len(at) * bins[f]).reshape(len(stats), len(at), bins[f]).cumsum(2)
            gain = _gains(h[:, :, :-1], h[:, :, -1:] - h[:, :, :-1], classes)
            first = gain.argmax(1)
            gain = gain[np.arange(len(at)), first]
            better = gain > best[at]
            best[at[better]], feature[at[better]], cut[at[better]] = gain[better], f, first[better]
        split = np.flatnonzero(best > 0)
        last = levels[-1]
        last[1][active[split]], last[2][active[split]], last[3][active[split]] = best[split], feature[split], cut[split]
        last[4][active[split]] = nodes + 2 * np.arange(len(split))
        child = np.full(m, -1)
        child[split] = 2 * np.arange(len(split))
        rows = np.flatnonzero(child[node] >= 0)
        codes, stats, node = codes[:, rows], stats[:, rows], node[rows]
        node = child[node] + (codes[feature[node], np.arange(len(rows))] > cut[node])
        n = 2 * len(split)
        if not n:
            break
        sums = _added(node, stats, n)
        levels.append([sums, np.full(n, -1.0), np.full(n, -1), np.full(n, -1), np.full(n, -1)])
        nodes += n
        active = np.flatnonzero(np.abs(_impurity(sums, classes)) >= np.finfo(float).eps)
        place = np.full(n, -1)
        place[active] = np.arange(len(active))
        rows = np.flatnonzero(place[node] >= 0)
        codes, stats, node = codes[:, rows], stats[:, rows], place[node[rows]]
    sums = np.concatenate([x[0] for x in levels], axis=1)
    gain, feature, cut, left = (np.concatenate([x[i] for x in levels]) for i in range(1, 5))
    with np.errstate(divide="ignore", invalid="ignore"):
        says = sums.argmax(0).astype(float) if classes else sums[1] / sums[0]
    for i in np.flatnonzero(left >= 0)[::-1]:
        j = left[i]
        if left[j] < 0 and left[j + 1] < 0 and says[j] == says[j + 1]:
            left[i] = -1
    kept = np.zeros(nodes, bool)
    kept[0] = True
    for i in np.flatnonzero(left >= 0):
        if kept[i]:
            kept[left[i]:left[i] + 2] = True
    to, inner = kept.cumsum() - 1, left[kept] >= 0
    children = np.where(inner, to[left[kept]], -1)
    counts = sums.sum(0) if classes else sums[0]
    return {"id": to[kept], "prediction": says[kept], "impurity": _impurity(sums[:, kept], classes), "impurityStats": sums[:, kept].T,
            "rawCount": counts[kept].astype(np.int64), "gain": np.where(inner, gain[kept], -1.0), "leftChild": children,
            "rightChild": np.where(inner, children + 1, -1), "feature": np.where(inner, feature[kept], -1), "bin": cut[kept]}


NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
         "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


def _node_rows(tree: int, t: dict, edges: list[np.ndarray]) -> pa.Table:
    """The nodes as MLlib saves them, thresholds between values."""
    def lists(values: list[np.ndarray]) -> pa.Array:
        size = np.cumsum([0, *map(len, values)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([*values, np.empty(0)])))
    inner = t["feature"] >= 0
    at = [edges[f][b:b + 1] if f >= 0 else np.empty(0) for f, b in zip(t["feature"], t["bin"])]
    split = pa.StructArray.from_arrays([pa.array(t["feature"], pa.int32()), lists(at), pa.array(np.full(len(inner), -1), pa.int32())],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    kinds = {"id": pa.int32(), "prediction": pa.float64(), "impurity": pa.float64(), "impurityStats": None, "rawCount": pa.int64(),
             "gain": pa.float64(), "leftChild": pa.int32(), "rightChild": pa.int32()}
    columns = [lists(list(t[k])) if kind is None else pa.array(t[k], kind) for k, kind in kinds.items()]
    data = pa.StructArray.from_arrays([*columns, split], [*kinds, "split"])
    return pa.table({"treeID": pa.array(np.full(len(inner), tree), pa.int32()), "nodeData": data})


def _grown(drawn: DataFrame, trees: int, edges: list[np.ndarray], classes: int | None, depth: int, seed: int, memory_mb: int) -> DataFrame:
    """The nodes of all trees. ``drawn``: (cell, y, s) of a classification, (cell, s) of a regression. A task
    grows some trees at a time and has all cells, but only the draws of these trees."""
    spark, bins, numbers = drawn.sparkSession, [len(e) + 1 for e in edges], 1 if classes else 3
    subset = int(np.ceil(np.sqrt(len(bins)))) if classes else len(bins)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        g, cells = table.column("g")[0].as_py(), table.column("cell").to_pylist()
        y = table.column("y").to_numpy()
        order = np.array(sorted(range(len(cells)), key=lambda i: (cells[i], y[i])))    # the same in every run
        codes = np.frombuffer(b"".join(cells[i] for i in order), np.uint8).reshape(len(cells), len(bins)).T.copy()
        s = table.column("s").combine_chunks().flatten().to_numpy().reshape(len(cells), numbers, -1)[order].transpose(2, 1, 0).copy()
        y = y[order].astype(np.int64)
        done = []
        for k in range(len(s)):
            tree = g * TOGETHER + k
            stats = s[k]
            if classes:
                stats = np.zeros((classes, len(y)))
                stats[y, np.arange(len(y))] = s[k, 0]
            t = grow_tree(codes, stats, bins, bool(classes), depth, subset, np.random.default_rng([seed & 0xFFFFFFFF, tree]), memory_mb)
            done.append(_node_rows(tree, t, edges))
        return pa.concat_tables(done)

    groups = -(-trees // TOGETHER)
    of = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.struct(g.alias("g"), F.concat(
        *[F.slice("s", g * TOGETHER + 1 + k * trees, F.least(F.lit(TOGETHER), trees - g * TOGETHER)) for k in range(numbers)]).alias("s")))
    some = drawn.select("cell", (F.col("y") if classes else F.lit(0.0)).alias("y"), F.inline(of))
    return some.repartition(groups, "g").groupBy("g").applyInArrow(run, NODES)


def _joined(spark: SparkSession, nodes: DataFrame, features: int, metadata: dict | None, classes: int | None, num_trees: int, params: dict):
    """One forest of the nodes: MLlib's own forest of as many bare roots is saved, with these nodes in their place."""
    x, y = array_to_vector(F.array(*[F.lit(0.0)] * features)).alias("x"), F.col("id").cast("double")
    bare = spark.range(classes or 1, numPartitions=1).select(x, y.alias("y", metadata=metadata or {}))
    estimator, wrapper = (RandomForestClassifier, RandomForestClassificationModel) if classes else (RandomForestRegressor, RandomForestRegressionModel)
    model = estimator(featuresCol="x", labelCol="y", numTrees=num_trees, maxDepth=0, seed=params["seed"]).fit(bare)._set(**params)
    path = scratch_dir(spark, "forest-cells")
    model.write().overwrite().save(path)
    nodes.write.mode("overwrite").parquet(f"{path}/data")
    forest = wrapper.load(path)
    forest.saved_at = path
    return forest


def fit_on_cells(vectors: DataFrame, target: str, label: str | None, columns: dict, num_trees: int, max_depth: int, seed: int,
                 memory_mb: int):
    """The fitted forest, or None where rows are few, or features or cells many.

    ``label``: the indexed label column of a classification, None for a regression of ``target``;
    ``columns``: the fitted model's column names."""
    spark, field = vectors.sparkSession, vectors.schema[label or target]
    rows = vectors.select(vector_to_array("_features").alias("x"), F.col(label or target).cast("double").alias("y"))
    n = rows.count()
    if n < ROWS:
        return None
    sample = [r["x"] for r in rows.select("x").sample(min(1.0, max(BINS * BINS, 10000) / n), seed).collect()]   # as MLlib's own
    if not sample or len(sample[0]) > FEATURES:
        return None
    x = np.array(sample)
    edges = [feature_edges(x[~np.isnan(x[:, j]), j]) for j in range(x.shape[1])]
    binned = _binned(rows, edges).persist(StorageLevel.MEMORY_AND_DISK)
    counted = binned.groupBy("cell", *(["y"] if label else [])).agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = counted.agg(F.count(F.lit(1)).alias("cells"), F.max("n").alias("most")).first()
        if found["cells"] > CELLS:
            return None
        classes = len(field.metadata["ml_attr"]["vals"]) if label else None
        if label:
            drawn = _drawn_classes(counted, num_trees, seed)
        else:
            drawn = _drawn_values(binned, num_trees, seed, -(-found["most"] // GROUP))
        nodes = _grown(drawn, num_trees, edges, classes, max_depth, seed, memory_mb)
        return _joined(spark, nodes, len(edges), field.metadata, classes, num_trees,
                       {**columns, "labelCol": label or target, "numTrees": num_trees, "maxDepth": max_depth, "seed": seed})
    finally:
        for d in (counted, binned):
            d.unpersist()
