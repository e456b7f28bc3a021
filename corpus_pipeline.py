"""The training-data pipeline: five stages over ``documents``, each written as Parquet
and read again as the next one's input.

Defined results: null, empty and wordless texts fail the quality stage; a null id or source is
a value of its own (ordered last) in every stage; of equal rows (same id and text) one passes
the near-duplicate stage; the mix may repeat any row, each repeat is packed; every stage but
the last keeps extra columns, whatever their names; an empty table, or one of which nothing
is left, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, line_quality, mixing, order_minhash, packed_tokens
from tessera.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then the documents that fail (operator 1)."""
    return line_quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (operator 10)."""
    return order_minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 7)."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks (operator 8)."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in bit-packed shards, read back per document (operator 4)."""
    return packed_tokens.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix),
          ("pack", pack)]

#: Alignment, edit matching and the tokenizer have no SQL form: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
