"""File sources and sinks.

Readers are lazy: they return a DataFrame whose scan Catalyst prunes and
filters. A pinned ``StructType`` should be passed whenever one is known;
schema inference is a full extra pass over the input and is only the fallback.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strings pandas' CSV reader treats as missing by default.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read lazily from Parquet."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A number as text: Java would also take a type letter (1d, 2f).
_NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _typed(c: str, t: T.DataType, na: list[str]) -> F.Column:
    v = F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c))
    if isinstance(t, T.StringType):
        return v
    if isinstance(t, (T.FloatType, T.DoubleType)):
        v = F.when(v.rlike(_NUMBER), v)
    return v.try_cast(t)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_values: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """CSV with a header row; every NA spelling becomes null before typing.

    Quoted fields may hold line breaks (``multiline``; then a file is one
    task, so large tables should come as many files; pass False for files
    known to have none). With ``schema`` the file is read as text and each
    column is ``try_cast`` to its pinned type (no inference pass). Without it
    the NA spellings are nulled on the text first and the types follow from
    all remaining values: long, else double, else boolean, else timestamp,
    else string (one aggregate over the file).
    """
    na = na_values if na_values is not None else NA_STRINGS
    reader = spark.read.option("header", True).option("multiLine", multiline) \
        .option("escape", '"').option("mode", "PERMISSIVE")
    if schema is not None:
        text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
        raw = reader.schema(text_schema).csv(path)
        return raw.select(*[_typed(f.name, f.dataType, na).alias(f.name) for f in schema.fields])
    raw = reader.csv(path)
    checks = []
    for i, c in enumerate(raw.columns):
        v = F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c))
        number = v.rlike(_NUMBER)
        tests = {"n": v.isNull(), "long": number & v.try_cast("long").isNotNull() & ~v.rlike("[.eE]"), "double": number,
                 "boolean": F.lower(v).isin("true", "false"), "timestamp_ntz": v.try_cast("timestamp_ntz").isNotNull() & v.rlike("^[0-9]{4}-")}
        checks += [F.min(t if k == "n" else F.when(v.isNull(), True).otherwise(t)).alias(f"{k}{i}") for k, t in tests.items()]
    found = raw.agg(*checks).first() if checks else None
    out = []
    for i, c in enumerate(raw.columns):
        empty = found[f"n{i}"] in (None, True)
        kind = "string" if empty else next((k for k in ("long", "double", "boolean", "timestamp_ntz") if found[f"{k}{i}"]), "string")
        out.append(_typed(c, T._parse_datatype_string(kind), na).alias(c))
    return raw.select(*out)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
              multiline: bool | None = None) -> DataFrame:
    """JSON records: JSON lines, or documents that are arrays of records.

    JSON lines split across tasks; an array document is read by one task per
    file. ``multiline=None`` looks at the first character of the input: ``[``
    means an array.
    """
    if multiline is None:
        head = spark.read.text(path).filter(F.trim("value") != "").limit(1).first()
        multiline = head is not None and head[0].lstrip("\ufeff \t").startswith("[")
    reader = spark.read.option("multiLine", multiline)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header and no index column."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Records as JSON lines, one part file per task."""
    df.write.mode(mode).json(path)
    return path


# Connector types named on the connector form; the file ones are handled here.
FILE_SUFFIXES = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
CONNECTOR_TYPES = {"postgres", "mysql", "rest", "csv_url", "json_url"}


def load_table(spark: SparkSession, path_or_url: str, source_type: str | None = None,
               schema: T.StructType | None = None, options: dict | None = None) -> DataFrame:
    """Pick a reader by connector type or by the lower-cased file suffix.

    ``postgres``/``mysql`` read over JDBC (``options`` carries url, dbtable or
    query, user, password, partitionColumn/lowerBound/upperBound/numPartitions);
    ``rest`` reads an already landed JSON directory; ``csv_url``/``json_url``
    read the path as CSV/JSON. Anything else is a ``ValueError``.
    """
    options = dict(options or {})
    if source_type:
        st = source_type.lower()
        if st in ("postgres", "mysql"):
            reader = spark.read.format("jdbc")
            for k, v in options.items():
                reader = reader.option(k, v)
            if "url" not in options:
                reader = reader.option("url", path_or_url)
            return reader.load()
        if st in ("rest", "json_url"):
            return read_json(spark, path_or_url, schema=schema)
        if st == "csv_url":
            return read_csv(spark, path_or_url, schema=schema)
        if st not in CONNECTOR_TYPES:
            raise ValueError(f"Unsupported source type: {source_type}")
    suffix = PurePosixPath(path_or_url.rstrip("/")).suffix.lower()
    kind = FILE_SUFFIXES.get(suffix)
    if kind == "csv":
        return read_csv(spark, path_or_url, schema=schema)
    if kind == "json":
        return read_json(spark, path_or_url, schema=schema)
    if kind == "parquet":
        return spark.read.parquet(path_or_url)
    raise ValueError(f"Unsupported file format: {suffix}")
