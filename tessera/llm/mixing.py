"""Operator 8: mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (the source's
target size over its size). The documents of a source are put in one fixed order
(size, hash of the id, id); the prefix sum of their expected copies runs along
that order from one random offset, and a document is emitted once for every
integer that its step of the prefix sum crosses. Since neighbours in the order
have nearly the same size, the words taken come near the target.

All rows of a source have the same step, so the prefix sum is its row numbers times
the step, in whole units of 2**-24 copies (exact 64-bit integers). It is
never computed in one task: rows are added up per block (source, size, first
three hex digits of the hash), and running sums of totals go over the blocks of a
size (at most 4,096), the sizes of a size class and the classes of a source. A
source or a group of equal texts that holds a third of all rows is spread over as
many blocks as its hashes.

Defined results: null or empty text has size 0; a null source is a source of its
own, ordered last; repeated rows (also repeated ids) are rows of their own; a
source of size 0 has target 0 and takes nothing; an empty table gives no rows;
``mix`` keeps all columns, whatever their names (a row travels as one struct). Ids should tell rows
apart: a row without id is placed by the hash of its text, equal rows side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table, whole_row, word_count

#: Units of one expected copy.
UNIT = 1 << 24
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> + target.

    Weights repeat over the sources by code point, null last. All targets add up
    to ``share`` of all sizes; a target stops at ``most`` times its source's size
    and what is above goes to the others by weight, until none is above. In closed
    form: with sources ordered by size over weight, a prefix of them is stopped.
    One row per source, so the windows here run over a small aggregated table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = (s.withColumn("stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
          .withColumn("rest_weight", F.sum("weight").over(rest))
          .withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(whole)))
    # the level (target per unit of weight) if exactly the sources before this one are stopped
    s = s.withColumn("level", (F.col("goal") - F.lit(float(most)) * F.col("stopped")) / F.col("rest_weight"))
    free = F.col("level") * F.col("weight") <= F.lit(float(most)) * F.col("source_size")
    s = s.withColumn("final", F.min(F.when(free, F.struct("stopped", "level"))).over(whole)["level"])
    top = F.lit(float(most)) * F.col("source_size")
    return s.select("source", "source_size", "weight",
                    F.when(F.col("final").isNull(), top)
                    .otherwise(F.least(top, F.col("final") * F.col("weight"))).alias("target"))


def _size_class(size):
    """A class that grows with the size: below 8 the size, then its number of bits and its next three bits."""
    bits = F.length(F.bin(size))
    top = F.floor(size / F.pow(F.lit(2.0), bits - 4))
    return F.when(size < 8, size).otherwise(bits * 8 + top - 8).cast("int")


def _marks(docs: DataFrame, key: str, source: str, size, text: str | None) -> DataFrame:
    """``docs`` and what places a row: source, size, size class, hash (of the id, for null ids of the text), block."""
    name = F.col(key).cast("string") if text is None else F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)))
    return (docs.withColumn("_source", F.col(source)).withColumn("_size", size)
                .withColumn("_hash", F.md5(F.coalesce(name, F.lit("")))).withColumn("_class", _size_class(F.col("_size")))
                .withColumn("_block", F.substring("_hash", 1, 3)))


def _starts(blocks: DataFrame) -> DataFrame:
    """Sums of units per (source, class, size, block) -> where each block starts in its source."""
    sizes = blocks.groupBy("_source", "_class", "_size").agg(F.sum("_sum").alias("_sum"))
    classes = sizes.groupBy("_source", "_class").agg(F.sum("_sum").alias("_sum"))

    def before(sums: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn(out, F.coalesce(F.sum("_sum").over(w), F.lit(0).cast("long")))

    classes = before(classes, ["_source"], "_class", "_b0").select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), "_b0")
    sizes = (before(sizes, ["_source", "_class"], "_size", "_b1").join(classes, _same(("_class", "_c")))
             .select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), (F.col("_b0") + F.col("_b1")).alias("_b1")))
    return (before(blocks, ["_source", "_size"], "_block", "_b2").join(sizes, _same(("_size", "_z")))
            .select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_block").alias("_b"),
                    (F.col("_b1") + F.col("_b2")).alias("_start"), "_units", "_source_size", "_target"))


def _same(*cols: tuple[str, str]):
    on = F.col("_source").eqNullSafe(F.col("_s"))
    for left, right in cols:
        on = on & (F.col(left) == F.col(right))
    return on


def plan_mix(marked: DataFrame, key: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MOST,
             seed: str = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their marks -> + _source_size, _target, _copies (integers that the row's step crosses)."""
    counts = cut(marked.groupBy("_source", "_class", "_size", "_block").agg(F.count("*").alias("_n")), "mix-counts")
    sizes = counts.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    goal = targets(sizes, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = F.least(F.floor(rate * F.lit(float(UNIT))).cast("long"), F.lit(int(most * UNIT)).cast("long"))
    goal = goal.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"),
                       F.col("target").alias("_target"), units.alias("_units"))
    blocks = counts.join(goal, _same()).drop("_s").withColumn("_sum", F.col("_n") * F.col("_units"))
    rows = marked.join(_starts(blocks), _same(("_size", "_z"), ("_block", "_b")))
    in_block = (Window.partitionBy("_source", "_size", "_block").orderBy("_hash", key, *ties)
                .rowsBetween(Window.unboundedPreceding, 0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_source"), F.lit("\0")))), 1, 6),
                    16, 10).cast("long")
    end = F.col("_start") + F.col("_units") * F.row_number().over(in_block) + offset
    return rows.withColumn("_end", end).withColumn("_copies", _crossed(F.col("_end"), F.col("_units")))


def _crossed(end, units):
    unit = F.lit(UNIT).cast("long")
    return (F.floor(end / unit) - F.floor((end - units) / unit)).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **params) -> DataFrame:
    """The mixed documents: each row of ``docs`` once per integer crossed, all columns kept.

    Planned on rows without their texts; whole rows move once, to where their copies are known.
    Rows of equal id, source and text lie side by side, so the first one's place tells all of theirs."""
    parts = [F.col(key).cast("string"), F.col(source).cast("string"), F.col(text)]
    told = [x for p in parts for x in (p.isNull(), F.coalesce(p, F.lit("")))]
    row = [F.xxhash64(F.lit(i), *told).alias(f"_k{i}") for i in range(2)]
    thin = docs.select(F.col(key).alias("_id"), F.col(source).alias("_from"), F.col(text).alias("_text"), *row)
    marked = _marks(thin, "_id", "_from", word_count(F.col("_text")), "_text").drop("_from", "_text")
    planned = plan_mix(marked, "_id", ties=("_k0", "_k1"), **params)
    first = planned.groupBy("_k0", "_k1").agg(F.min("_end").alias("_first"), F.first("_units").alias("_units"))
    nth = F.row_number().over(Window.partitionBy("_k0", "_k1").orderBy("_k0")) - 1
    rows = docs.select(whole_row(docs), *row).join(first, ["_k0", "_k1"]).withColumn("_nth", nth)
    copies = _crossed(F.col("_first") + F.col("_nth") * F.col("_units"), F.col("_units"))
    return (rows.withColumn("_copies", copies).filter("_copies > 0")
                .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # ids, sources and counted words once; the texts are not needed again
    narrow = cut(_marks(docs, "doc_id", "source", word_count(F.col("text")), "text")
                 .select("doc_id", "_source", "_size", "_class", "_hash", "_block"), "mix-rows")
    return plan_mix(narrow).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken"), F.col("_copies").alias("copies"))


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, md5(text), '')) AS h, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
lv AS (
  SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest_weight,
         {SHARE}::DOUBLE * (sum(source_size) OVER ())::BIGINT AS goal
  FROM src WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
lv2 AS (SELECT *, (goal - {float(MOST)}::DOUBLE * stopped) / rest_weight AS level FROM lv),
fin AS (SELECT arg_min(level, stopped) AS level FROM lv2 WHERE level * weight <= {float(MOST)}::DOUBLE * source_size),
goal AS (
  SELECT source, source_size,
         CASE WHEN fin.level IS NULL THEN {float(MOST)}::DOUBLE * source_size
              ELSE least({float(MOST)}::DOUBLE * source_size, fin.level * weight) END AS target
  FROM lv2, fin),
units AS (
  SELECT s.doc_id, s.source, s.size, s.h, g.source_size, g.target,
         least(floor(CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END * {UNIT}.0::DOUBLE)::BIGINT,
               {MOST * UNIT}) AS units
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
ends AS (
  SELECT *, sum(units) OVER (PARTITION BY source ORDER BY size, h, doc_id
                             ROWS UNBOUNDED PRECEDING)::BIGINT
            + ('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0))), 1, 6))::BIGINT AS e
  FROM units)
SELECT doc_id, size, source_size, target,
       ((e // {UNIT} - (e - units) // {UNIT}) * size)::BIGINT AS taken,
       (e // {UNIT} - (e - units) // {UNIT})::INT AS copies
FROM ends
"""
