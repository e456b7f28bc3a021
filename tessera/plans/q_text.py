"""Text and vector queries (conversations, documents, embeddings)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import passage_index as PI
from tessera.operators import text as TX
from tessera.operators import vector_index as VI
from tessera.plans import fixtures as fx
from tessera.plans.registry import register
from tessera.session import scratch_dir
from tessera.sources.files import table


def _intent_case(col: str = "text") -> str:
    parts = []
    for topic, words in TX.INTENT_GROUPS:
        cond = " OR ".join(f"contains(lower({col}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{topic}'")
    return "CASE " + " ".join(parts) + f" ELSE '{TX.FALLBACK_TOPIC}' END"


@register("intent_route", f"WITH pr AS ({fx.PROMPTS_SQL}) SELECT conv_id, turn, role, text, {_intent_case()} AS topic FROM pr")
def q_intent_route(spark, sf_dir):
    return TX.intent_route(fx.prompts(spark, sf_dir))


@register("intent_route_raw", f"SELECT conv_id, turn, role, text, {_intent_case()} AS topic FROM conversations")
def q_intent_route_raw(spark, sf_dir):
    return TX.intent_route(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@register("intent_summary", f"""WITH pr AS ({fx.PROMPTS_SQL})
SELECT role, {_intent_case()} AS topic, count(*) AS "count" FROM pr GROUP BY 1, 2""")
def q_intent_summary(spark, sf_dir):
    return TX.intent_summary(TX.intent_route(fx.prompts(spark, sf_dir)))


@register("conversation_title", """
SELECT conv_id, substr(arg_min(text, turn) FILTER (role = 'user'), 1, 40) || '...' AS title FROM conversations GROUP BY 1""")
def q_conversation_title(spark, sf_dir):
    return TX.conversation_title(table(spark, sf_dir, "conversations"))


@register("tokenize_words", """
WITH s AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
p AS (SELECT conv_id, turn, w, unnest(range(len(w))) AS pos FROM s)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, w[pos + 1] || CASE WHEN pos < len(w) - 1 THEN ' ' ELSE '' END AS chunk FROM p""")
def q_tokenize_words(spark, sf_dir):
    return TX.tokenize_words(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@register("word_counts", """
SELECT word, count(*) AS "count" FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM conversations)
WHERE word <> '' GROUP BY 1""")
def q_word_counts(spark, sf_dir):
    return TX.word_counts(table(spark, sf_dir, "conversations"))


PASSAGES_SQL = """
SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(chunk_id * 150 AS INTEGER) AS start_word,
       CAST(len(list_slice(w, chunk_id * 150 + 1, chunk_id * 150 + 200)) AS INTEGER) AS n_words,
       array_to_string(list_slice(w, chunk_id * 150 + 1, chunk_id * 150 + 200), ' ') AS text
FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) <= 200 THEN 1 ELSE CAST(ceil((len(w) - 200) / 150) AS INTEGER) + 1 END)) AS chunk_id
      FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g'), '[\\t\\n\\f\\r ]+') AS w
            FROM documents))"""


@register("index_documents", PASSAGES_SQL)
def q_index_documents(spark, sf_dir):
    return TX.index_documents(table(spark, sf_dir, "documents"))


POSTINGS_CTE = f"""
w AS (SELECT doc_id, chunk_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM ({PASSAGES_SQL})),
postings AS (SELECT term, doc_id, chunk_id, count(*) AS tf, n_words
             FROM (SELECT doc_id, chunk_id, CAST(len(w) AS INTEGER) AS n_words, unnest(w) AS term FROM w) GROUP BY ALL)"""


@register("index_postings", f"WITH {POSTINGS_CTE} SELECT * FROM postings")
def q_index_postings(spark, sf_dir):
    """The written postings of all passages."""
    passages = TX.index_documents(table(spark, sf_dir, "documents"))
    return PI.build(passages, scratch_dir(spark, "passages"), ["doc_id", "chunk_id"]).postings


@register("passage_search", f"""
WITH {POSTINGS_CTE},
size AS (SELECT count(*) AS passages, sum(len(w)) AS words FROM w WHERE len(w) > 0),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(list_filter(string_split(lower(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g')), ' '), lambda x: x <> '')) AS term
        FROM benchmark) GROUP BY ALL),
i AS (SELECT q.*, ln(1.0 + (passages - df + 0.5) / (df + 0.5)) AS idf FROM q JOIN terms USING (term), size),
s AS (SELECT item_id, doc_id, chunk_id, sum(CAST(round(idf * tf * {PI.K1 + 1.0}
        / (tf + {PI.K1} * ({1.0 - PI.B} + {PI.B} * n_words / (words / passages))) * {PI.UNIT}) AS BIGINT) * times) AS s
      FROM i JOIN postings USING (term), size GROUP BY ALL)
SELECT item_id, doc_id, chunk_id, round(s / {PI.UNIT}, 4) AS score,
       CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id, chunk_id) AS INTEGER) AS "rank"
FROM s QUALIFY "rank" <= 10""")
def q_passage_search(spark, sf_dir):
    """The ten best passages for each benchmark text."""
    passages = TX.index_documents(table(spark, sf_dir, "documents"))
    index = PI.build(passages, scratch_dir(spark, "passages"), ["doc_id", "chunk_id"])
    return PI.search(index, table(spark, sf_dir, "benchmark"), k=10, query_id="item_id")


def _queries(emb):
    firsts = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return emb.join(firsts, ["label", "vec_id"]).select(F.col("vec_id").alias("query_id"),
                                                         F.col("embedding").alias("query_vec"))


@register("semantic_search", """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
s AS (SELECT q.query_id, e.vec_id, e.label,
             round(list_cosine_similarity(CAST(q.qv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 4) AS similarity
      FROM q, embeddings e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT * FROM r WHERE "rank" <= 5""")
def q_semantic_search(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return VI.exact_search(emb, _queries(emb), k=5, extra=["label"])


def _every_fiftieth(emb):
    return emb.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@register("semantic_search_index")
def q_semantic_search_index(spark, sf_dir):
    """Every 50th vector as a query against the index of all (recall is measured by the next query)."""
    emb = table(spark, sf_dir, "embeddings")
    return VI.index_and_search(emb, _every_fiftieth(emb), k=5, extra=["label"])


@register("semantic_search_recall")
def q_semantic_search_recall(spark, sf_dir):
    """The index against the exact search for the same queries."""
    emb = table(spark, sf_dir, "embeddings")
    asked = _every_fiftieth(emb)
    return VI.recall(VI.exact_search(emb, asked, k=5), VI.index_and_search(emb, asked, k=5))
