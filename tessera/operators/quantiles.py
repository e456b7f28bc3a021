"""Exact quantiles without holding a group in one task.

``percentile`` keeps a value->count map per group and merges all maps of a
group in one task: memory grows with the number of distinct values, and a hot
group (a third of the rows) lands in one task whole. ``grouped_quantiles``
computes the same numbers with bounded per-task memory:

1. count rows per (group, value) -- partial aggregation collapses duplicates;
2. range-partition those counts on (group, value): the sampled range bounds
   split a hot group over many tasks;
3. running counts inside each (partition, group), plus per-(partition, group)
   totals turned into offsets (a small table: groups x partitions);
4. keep only the value rows that hold the target ranks floor/ceil(q (N - 1))
   and interpolate the way ``percentile`` does.

Cost: the distinct (group, value) counts are shuffled and checkpointed once
(range bounds are sampled, so the partition ids are materialised for all
later steps), then two small shuffles; in exchange no buffer is unbounded. ``method='map'`` uses
``percentile`` (one pass, fine for low-cardinality values), ``'sketch'`` uses
``percentile_approx`` (bounded, approximate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import scan_bytes
from tessera.session import _ensure_checkpoint_dir

METHODS = ("distributed", "map", "sketch")
#: Bytes of (group, value) input for each range partition.
PARTITION_BYTES = 64 << 20


def grouped_quantiles(df: DataFrame, value: str, qs: list[float], groups: list[str] | None = None,
                      method: str = "distributed", partitions: int | None = None) -> DataFrame:
    """(groups..., q, value) for every group and each q in ``qs``; nulls
    ignored, NaN must already be nulled by the caller. Linear interpolation
    between the two nearest ranks (pandas / ``percentile`` / DuckDB
    ``quantile_cont``)."""
    g = list(groups or [])
    v = F.col(value).cast("double")
    base = df.select(*g, v.alias("_v")).filter(F.col("_v").isNotNull())
    if method in ("map", "sketch"):
        arr = (F.percentile_approx("_v", qs, 10000) if method == "sketch"
               else F.percentile("_v", F.array(*[F.lit(q) for q in qs])))
        agg = base.groupBy(*g).agg(arr.alias("_a"))
        return agg.select(*g, F.posexplode("_a").alias("_i", "value")).select(
            *g, F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1).alias("q"), "value")
    if method != "distributed":
        raise ValueError(f"method must be one of {METHODS}")
    spark = df.sparkSession
    # partitions follow the input's size, so that no window below grows with it
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-scan_bytes(base) // PARTITION_BYTES))
    counts = base.groupBy(*g, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # Range bounds are sampled: materialise the partition ids once (reliable
    # checkpoint in the shared folder) so every branch below sees the same
    # assignment, also after an executor loss.
    _ensure_checkpoint_dir(spark)
    ranged = counts.repartitionByRange(parts, *[F.col(c) for c in g], F.col("_v")) \
        .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    run = Window.partitionBy("_pid", *g).orderBy("_v")
    local = ranged.select("*", F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                          .alias("_before"))
    # one row per (partition, group): bounded by partitions + groups
    tot = ranged.groupBy("_pid", *g).agg(F.sum("_n").alias("_pn"))
    prior = Window.partitionBy(*g).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *g, F.coalesce(F.sum("_pn").over(prior), F.lit(0)).alias("_off"),
                      F.sum("_pn").over(Window.partitionBy(*g)).alias("_total"))
    offs = offs.select(F.col("_pid").alias("_op"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(g)], "_off", "_total")
    on = F.col("_pid") == F.col("_op")
    for i, c in enumerate(g):                      # a null group is a group
        on = on & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    j = local.join(offs, on)
    start = F.col("_off") + F.col("_before")

    def holds(r):
        return (start <= r) & (r < start + F.col("_n"))

    # keep a value row only for the quantiles whose ranks floor/ceil(q (N - 1)) it holds
    def ranks(q):
        pos = q * (F.col("_total") - 1)
        return F.struct(q.alias("q"), holds(F.floor(pos)).alias("lo"), holds(F.ceil(pos)).alias("hi"))

    held = F.filter(F.array(*[ranks(F.lit(float(q))) for q in qs]), lambda x: x["lo"] | x["hi"])
    hits = j.select(*g, "_v", "_total", held.alias("_h")).filter(F.size("_h") > 0) \
        .select(*g, "_v", "_total", F.inline("_h"))
    res = hits.groupBy(*g, "q").agg(
        F.max(F.when(F.col("lo"), F.col("_v"))).alias("_vlo"), F.max(F.when(F.col("hi"), F.col("_v"))).alias("_vhi"),
        F.first("_total").alias("_total"))
    p = F.col("q") * (F.col("_total") - 1)
    lo, hi = F.floor(p), F.ceil(p)
    interp = F.when((lo == hi) | (F.col("_vlo") == F.col("_vhi")), F.col("_vlo")).otherwise(
        (hi - p) * F.col("_vlo") + (p - lo) * F.col("_vhi"))
    return res.select(*g, "q", interp.alias("value"))


def quantile_arrays(df: DataFrame, value: str, qs: list[float], groups: list[str] | None = None,
                    method: str = "distributed") -> DataFrame:
    """(groups..., quantiles array<double> ordered by increasing q)."""
    g = list(groups or [])
    long = grouped_quantiles(df, value, qs, g, method)
    agg = long.groupBy(*g).agg(F.sort_array(F.collect_list(F.struct("q", "value"))).alias("_s"))   # len(qs) items
    return agg.select(*g, F.col("_s.value").alias("quantiles"))


def weighted_quantile(counts: DataFrame, value: str, weight: str, q: float, groups: list[str]) -> DataFrame:
    """(groups..., quantile) of values given with their counts: running counts in value order.

    Rows are (group, value) counts already; a group's window sorts its distinct values."""
    w = Window.partitionBy(*groups)
    run = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("_end", F.sum(weight).over(run)).withColumn("_total", F.sum(weight).over(w))
    pos = F.lit(float(q)) * (F.col("_total") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    start = F.col("_end") - F.col(weight)

    def at(r):
        return F.max(F.when((start <= r) & (r < F.col("_end")), F.col(value)))

    g = c.groupBy(*groups).agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.first("_total").alias("_total"))
    pos = F.lit(float(q)) * (F.col("_total") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    v = F.when((lo == hi) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(
        (hi - pos) * F.col("_lo") + (pos - lo) * F.col("_hi"))
    return g.select(*groups, v.cast("double").alias("quantile"))
