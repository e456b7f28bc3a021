"""Text routing, tokenising and passage building.

All per-row work is built-in expressions (``split``, ``slice``, ``transform``,
``aggregate``); nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import spread

# Intent keyword groups, checked in this order; the first group
# with a keyword contained in the lower-cased prompt wins.
INTENT_GROUPS = [
    ("revenue", ["revenue", "sales", "money", "income"]),
    ("churn", ["churn", "retention", "customer loss"]),
    ("anomaly", ["anomaly", "anomalies", "spike", "outlier", "alert"]),
    ("forecast", ["forecast", "predict", "projection", "future"]),
    ("model", ["model", "ml", "accuracy", "classifier", "regressor"]),
    ("streaming", ["stream", "kafka", "event", "real-time", "realtime"]),
]
FALLBACK_TOPIC = "general"


def intent_expr(text_col: str = "text") -> F.Column:
    low = F.lower(F.col(text_col))
    expr = None
    for topic, words in INTENT_GROUPS:
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else cond | c
        expr = F.when(cond, F.lit(topic)) if expr is None else expr.when(cond, F.lit(topic))
    return expr.otherwise(F.lit(FALLBACK_TOPIC))


def intent_route(prompts: DataFrame, text_col: str = "text") -> DataFrame:
    return prompts.withColumn("topic", intent_expr(text_col))


def intent_summary(routed: DataFrame, by: str = "role") -> DataFrame:
    return routed.groupBy(by, "topic").agg(F.count(F.lit(1)).alias("count"))


def conversation_title(conv: DataFrame, width: int = 40) -> DataFrame:
    """First ``width`` characters of the first user turn + '...'; a conversation
    without a user turn has the title null."""
    is_user = F.col("role") == "user"
    first = conv.groupBy("conv_id").agg(F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("first_text"))
    return first.select("conv_id", F.concat(F.substring("first_text", 1, width), F.lit("...")).alias("title"))


def tokenize_words(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per word split on single spaces; every chunk but the last keeps
    its trailing space, so the chunks concatenate back to the text."""
    words = F.split(F.col(text_col), " ", -1)
    x = df.select(*keys, F.posexplode(words).alias("pos", "word"), F.size(words).alias("_n"))
    return x.select(*keys, "pos", F.when(F.col("pos") < F.col("_n") - 1, F.concat("word", F.lit(" ")))
                    .otherwise(F.col("word")).alias("chunk"))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, count) over lower-cased space-separated tokens, empty tokens dropped."""
    w = df.select(F.explode(F.split(F.lower(F.col(text_col)), " ", -1)).alias("word")).filter(F.col("word") != "")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


WS = "[\\t\\n\\f\\r ]+"


def index_documents(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 200,
                    overlap: int = 50) -> DataFrame:
    """Passages of ``size`` words every ``size - overlap`` words over the whole
    text: (doc_id, chunk_id, start_word, n_words, text). The last passage is
    the first that reaches the end of the text."""
    stride = size - overlap
    words = F.split(F.regexp_replace(F.col(text_col), "^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$", ""), WS, -1)
    # per-document work is heavy (regex split, joins): spread a thin scan first
    d = spread(docs.select(key, text_col), [key]).select(key, words.alias("_w")).withColumn("_n", F.size("_w"))
    n_chunks = F.when(F.col("_n") <= size, F.lit(1)).otherwise(
        F.ceil((F.col("_n") - size) / F.lit(stride)).cast("int") + 1)

    def passage(i):
        piece = F.slice(F.col("_w"), i * stride + 1, size)
        return F.struct(i.alias("chunk_id"), (i * stride).alias("start_word"), F.size(piece).alias("n_words"),
                        F.array_join(piece, " ").alias("text"))

    # All passages are built inside the row (about 1.33x the text), then
    # inlined: exploded rows never carry the whole word array.
    return d.select(key, F.inline(F.transform(F.sequence(F.lit(0), n_chunks - 1), passage)))

