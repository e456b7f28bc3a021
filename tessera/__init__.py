"""tessera: business analytics operators written on the Spark DataFrame, SQL,
MLlib and Structured Streaming APIs.

Every operator is a function that takes and returns lazy DataFrames; the
physical plan is left to Catalyst and AQE.
"""

from tessera.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
