"""Small documents with every awkward case, shared by the tests of this folder."""

from __future__ import annotations

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

P = ("The quick survey of northern rivers found that most of the smaller streams carry less sand than before, "
     "and that the banks have moved by several metres in the last ten years of heavy rain and long dry summers.")
LONG = " ".join(f"word{i % 977} stone{i % 31} river{i}." for i in range(9000))

DOCS = [
    (1, P + "\n" + "A second line of plain words follows here, with an end.", "en", "a", 0),
    (2, P + "\n" + "A second line of plain words follows here, with an end.", "en", "b", 0),
    (3, "", "en", "a", 0),
    (4, None, "en", None, None),
    (None, P.replace("sand", "silt") + " Something else stands at the end of this one.", None, "c", 5),
    (None, None, None, None, None),
    (7, LONG, "en", "a", 0),
    (7, LONG, "en", "a", 0),
    (8, " \t \n\n ", "en", "", 0),
    (9, "home | about | contact\nAll rights reserved.\n" + P, "en", "b", 0),
    (10, "one two\x1cthree\x85four five\xa0six <| <\\| <|im_end|> \U0001f600", "en", "a", 0),
]


def documents(spark, rows=DOCS):
    return spark.createDataFrame(rows, DOC_SCHEMA)


def with_clashes(df, *names):
    """Extra columns, some named like what the operators make."""
    from pyspark.sql import functions as F
    for n in names:
        df = df.withColumn(n, F.lit(n))
    return df
