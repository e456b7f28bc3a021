"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import qualified

#: A word is a run of characters other than space and U+0009..U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The same six separators, for Python's ``str`` methods.
SPACE = " \t\n\x0b\x0c\r"

#: The columns of the ``documents`` table.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What str.split() takes for white space besides the six separators.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def split_words(text: str) -> list[str]:
    """The words of ``text`` (str.split() where it cuts alike, else bytes.split(), which cuts at the six)."""
    if not _OTHER_SPACE.search(text):
        return text.split()
    return [w.decode("utf-8") for w in text.encode("utf-8").split()]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names.

    Only where no such folder is set and Spark runs in one local process (tests)
    is a local one made. A path without scheme is one of the cluster's default file system.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile
        root = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = qualified(spark, root)     # pyarrow would take a plain path for the machine's own disk
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: every later use reads
    the same rows once computed, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_row(df: DataFrame) -> F.Column:
    """All columns of ``df`` as one struct ``_doc``: names of the caller and of an operator then cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc")


def word_count(col) -> F.Column:
    """Number of words of a text column, null counting as 0 (built-in expressions only)."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(batches: Iterator[pa.RecordBatch], text: int, chars: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part has some ``chars`` of text in column ``text`` (or one row)."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            total += n
            if total >= chars:
                yield b.slice(first, i + 1 - first)
                first, total = i + 1, 0
        if first < len(sizes):
            yield b.slice(first)
