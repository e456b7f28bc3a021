"""Expression builders.

All of these return ``Column`` objects made of built-in functions so they stay
inside whole-stage codegen. Nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)

# Money is summed as an exact decimal so results do not depend on the order in
# which partitions are merged (double sums do).
MONEY = T.DecimalType(18, 4)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c) -> Column:
    """Per-row money value as decimal(18,4)."""
    return col(c).cast(MONEY)


def money_sum(c, scale: int = 2) -> Column:
    """Exact sum of a money expression, rounded in decimal, returned as double."""
    return F.round(F.sum(money(c)), scale).cast("double")


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI-safe)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct_change(cur, prev, scale: int = 2) -> Column:
    """round((cur - prev) / prev * 100, scale); null when prev is 0 or null."""
    return F.round(F.try_divide(col(cur) - col(prev), col(prev)) * 100.0, scale)


def round4(c) -> Column:
    return F.round(col(c), 4)


# Severity cuts on |z| that classify the ten published anomaly
# records (z = 6.2, 7.4 critical; 4.8, -3.9, 5.1 high; 3.6, 3.1, -3.3 medium;
# -2.8, -2.4 low).
SEVERITY_CUTS = [(6.0, "CRITICAL"), (3.8, "HIGH"), (3.0, "MEDIUM"), (2.0, "LOW")]


def severity_from_z(z, cuts=SEVERITY_CUTS) -> Column:
    """Severity label for a z-score; null below the lowest cut or when z is null."""
    az = F.abs(col(z))
    expr = None
    for cut, label in cuts:
        expr = F.when(az >= cut, F.lit(label)) if expr is None else expr.when(az >= cut, F.lit(label))
    return expr


def is_missing(c: str, dtype: T.DataType) -> Column:
    """Null, or NaN for floating columns: the one missing marker of the profile."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def cosine_similarity(a, b) -> Column:
    """Cosine of two numeric arrays of equal length, computed in double."""
    a, b = col(a), col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.try_divide(dot, F.sqrt(na) * F.sqrt(nb))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns pandas would call numeric: ints, floats, decimals; not bool."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def hour_start(c) -> Column:
    """Start of the hour of a TIMESTAMP_NTZ, computed from its fields (no
    session time zone involved; ``date_trunc`` would return a zoned TIMESTAMP)."""
    c = col(c)
    return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))


def day_start(c) -> Column:
    """Midnight of the day of a TIMESTAMP_NTZ, as TIMESTAMP_NTZ."""
    return F.to_date(col(c)).cast("timestamp_ntz")


# --- zone-independent time handling ------------------------------------------
# The test timestamps are TIMESTAMP_NTZ (wall clock, no zone). Python datetime
# literals and casts to TIMESTAMP go through the session time zone; these
# helpers never do, so results are the same in any session.
EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_lit(d) -> Column:
    """A datetime / date as a TIMESTAMP_NTZ / DATE literal (parsed from text)."""
    import datetime as _dt
    if isinstance(d, _dt.datetime):
        return F.lit(d.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(d, _dt.date):
        return F.lit(d.isoformat()).cast("date")
    return F.lit(d)


def micros_between(start, end) -> Column:
    """end - start in microseconds, for TIMESTAMP_NTZ values."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def ntz_to_instant(c) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP, reading the wall clock as UTC (for event-time
    operators such as watermarks, which need TIMESTAMP)."""
    return F.timestamp_micros(micros_between(F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c))


def instant_to_ntz(c) -> Column:
    """TIMESTAMP -> TIMESTAMP_NTZ, the UTC wall clock (inverse of ntz_to_instant)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(c)), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


# --- sizes from the plan, without running a job ---------------------------------
def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, from the plan's leaves (no job); inputs of unknown size count 0.

    Estimates above the leaves are left aside: without column statistics a join is the product of its sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def spread(df: DataFrame, key: list[str] | None = None, bytes_each: int | None = None) -> DataFrame:
    """Hash-repartition a small input to the session's shuffle partitions.

    A few unsplittable files would otherwise keep the per-row work in a few
    tasks. Decided by the estimated size alone (below one scan partition per
    shuffle partition), so without a job and alike on every cluster. With
    ``bytes_each`` into no more partitions than hold so many bytes of the scan
    each, or twice the cores if that is more: for work of many short passes,
    whose time goes with the number of its tasks."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if scan_bytes(df) >= n * unit:
        return df
    if bytes_each:
        n = min(n, max(2 * spark.sparkContext.defaultParallelism, -(-scan_bytes(df) // bytes_each)))
    return df.repartition(n, *[F.col(k) for k in key]) if key else df.repartition(n)
