"""The given tables in the shape the operators read, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.functions.models import HashedWords
from passagebook.functions.text import MAP_STRING, metadata_json
from passagebook.operators.embedding import embed
from passagebook.operators.ingest import ingest
from passagebook.schemas import TRANSCRIPTIONS, conform
from passagebook.settings import Settings
from passagebook.sources.session import materialize

DIM = 256
SIZE, OVERLAP = 512, 50
STEP = SIZE - OVERLAP
LEAST = 0.6
CONTEXT_TOKENS = 600

FIXED = Settings(chunking_strategy="fixed", embedding_dimension=DIM)


def embedder() -> HashedWords:
    return HashedWords(DIM)


def created_at():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_transcriptions(documents: DataFrame) -> DataFrame:
    tags = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return conform(
        documents.select(
            F.col("doc_id").cast("string").alias("transcription_id"),
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("audio_file_path"),
            "text",
            (F.col("n_chars") / F.lit(15.0)).alias("duration_seconds"),
            F.col("lang").alias("language"),
            metadata_json(tags.cast(MAP_STRING)).alias("metadata"),
            created_at().alias("created_at"),
        ),
        TRANSCRIPTIONS,
    )


def transcriptions(spark: SparkSession, sf: str) -> DataFrame:
    return as_transcriptions(table(spark, sf, "documents"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """document_id and text."""
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label"
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vector")
    )


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text")
    )


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest(transcriptions(spark, sf), created_at(), FIXED)


def text_index(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of all documents with their hashed-word vectors, as a stored table: a search
    reads ids and vectors, and the texts of what it finds."""
    chunks = chunk_rows(spark, sf).select(
        "chunk_id", "document_id", "metadata", "chunk_index", "content"
    )
    return materialize(embed(chunks, embedder(), keep_text=True).drop("attempts", "error", "token_count"), "text-index")


def document_table(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a chunk table, with the vectors of the embeddings table by id."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.col("text").alias("content"),
        F.lit(0).alias("chunk_index"),
    )
    return docs.join(vectors(spark, sf).drop("label"), "chunk_id", "left")


def task_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as task runs: one task per user, an error event is a failed run."""
    failed = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("task_name"),
        F.col("ts").cast("timestamp").alias("run_timestamp"),
        F.col("value").alias("duration_seconds"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        F.lit(1).cast("bigint").alias("records_processed"),
        failed.cast("bigint").alias("records_failed"),
        F.col("props").alias("metrics"),
    )


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and the suppliers they bought from, with the number of order lines."""
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "l_suppkey")
        .agg(F.count(F.lit(1)).alias("n_times"))
        .select(
            F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
            F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
            "n_times",
        )
    )


def trade_nodes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id"), "n_times").unionAll(edges.select("dst", "n_times"))
    return ends.groupBy("id").agg(F.sum("n_times").alias("n_times"))


# ---- the same in SQL -----------------------------------------------------------------

SPACE_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
SPACE_RE_SQL = r"'[ \t\n\r\x0b\x0c]+'"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {SPACE_RE_SQL}), lambda w: w <> '')"


def word_set_sql(text: str) -> str:
    return f"list_distinct({words_sql(f'lower({text})')})"


def sentences_sql(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?])[ \\t\\n\\r\\x0b\\x0c]+', '\\1' || chr(1), 'g'), chr(1))"


TRANSCRIPTIONS_SQL = """
  SELECT CAST(doc_id AS VARCHAR) AS transcription_id,
         source || '/' || doc_id AS audio_file_path, text,
         CAST(CAST(n_chars AS DOUBLE) / CAST(15.0 AS DOUBLE) AS FLOAT) AS duration_seconds,
         lang AS language, CAST(NULL AS VARCHAR) AS model,
         '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM documents"""


def windows_sql(count: str, content: str) -> str:
    """CTEs win and chunks: windows of the documents, numbered without the blank ones."""
    return f"""
win AS (
  SELECT doc_id, source, lang, k, k * {STEP} AS start_char, least(k * {STEP} + {SIZE}, length(text)) AS end_char,
         {content} AS content
  FROM (SELECT *, unnest(range(CAST({count} AS BIGINT))) AS k FROM documents)),
numbered AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, source, lang,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index,
         CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, content
  FROM win WHERE trim(content, {SPACE_SQL}) <> ''),
chunks AS (
  SELECT *, substr(sha256(document_id || ':' || chunk_index || ':' || substr(content, 1, 100)), 1, 16) AS chunk_id
  FROM numbered)"""


CHUNKS_SQL = windows_sql(
    f"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil((length(text) - {OVERLAP}) / CAST({STEP} AS DOUBLE))) END",
    f"trim(substr(text, k * {STEP} + 1, {SIZE}), {SPACE_SQL})",
)


def hashed_sql(name: str, key: str, text: str, source: str) -> str:
    """CTE with one row per non-zero vector element: key, bucket, weight."""
    return f"""
{name} AS (
  SELECT {key}, bucket, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS weight
  FROM (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS bucket, CAST(count(*) AS DOUBLE) AS c
        FROM (SELECT {key}, unnest({words_sql(f"lower({text})")}) AS w FROM {source})
        GROUP BY ALL))"""


QUERIES_SQL = "queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query_text FROM benchmark)"


def found_sql(k: int) -> str:
    """CTE found: the k nearest chunks of every query, by vector."""
    return f"""
scored AS (
  SELECT query_id, chunk_id, round(sum(q.weight * c.weight), 6) AS score
  FROM query_vectors q JOIN chunk_vectors c USING (bucket) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored),
found AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, score, chunk_id, content, document_id, chunk_index, source, lang
  FROM placed JOIN chunks USING (chunk_id) WHERE rank <= {k})"""


def vector_search_sql(k: int, queries: str = QUERIES_SQL) -> str:
    return ",".join(
        [
            "WITH " + queries,
            CHUNKS_SQL,
            hashed_sql("query_vectors", "query_id", "query_text", "queries"),
            hashed_sql("chunk_vectors", "chunk_id", "content", "chunks"),
            found_sql(k),
        ]
    )


def hybrid_sql(k: int = 10, queries: str = QUERIES_SQL) -> str:
    """CTE hybrid: k results per query after the keyword score."""
    asked, held = word_set_sql("query_text"), word_set_sql("content")
    return (
        vector_search_sql(2 * k, queries)
        + f""",
weighed AS (
  SELECT found.* EXCLUDE (score, rank), query_text, rank AS vector_rank,
         round(CAST(0.7 AS DOUBLE) * score + CAST(0.3 AS DOUBLE)
               * (len(list_intersect({asked}, {held})) / CAST(greatest(len({asked}), 1) AS DOUBLE)), 10) AS score
  FROM found JOIN queries USING (query_id)),
hybrid AS (
  SELECT * EXCLUDE (r), CAST(r AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank) AS r FROM weighed)
  WHERE r <= {k})"""
    )


def hybrid_exact_sql(k: int = 10) -> str:
    """All chunks weighed for every query: words of both as sets, vectors by bucket."""
    return ",".join(
        [
            "WITH " + QUERIES_SQL, CHUNKS_SQL, hashed_sql("query_vectors", "query_id", "query_text", "queries"),
            hashed_sql("chunk_vectors", "chunk_id", "content", "chunks"),
        ]
    ) + f""",
near AS (
  SELECT query_id, chunk_id, round(sum(q.weight * c.weight), 6) AS near
  FROM query_vectors q JOIN chunk_vectors c USING (bucket) GROUP BY ALL),
q AS (SELECT query_id, {word_set_sql("query_text")} AS asked FROM queries),
c AS (SELECT chunk_id, content, {word_set_sql("content")} AS held FROM chunks),
weighed AS (
  SELECT query_id, chunk_id, content,
         round(CAST(0.7 AS DOUBLE) * coalesce(near, 0) + CAST(0.3 AS DOUBLE)
               * (len(list_intersect(asked, held)) / CAST(greatest(len(asked), 1) AS DOUBLE)), 10) AS score
  FROM q CROSS JOIN c LEFT JOIN near USING (query_id, chunk_id))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank,
       score, chunk_id, content
FROM weighed QUALIFY rank <= {k}"""


def context_sql(k: int = 10, queries: str = QUERIES_SQL, least: float = LEAST, budget: int = CONTEXT_TOKENS) -> str:
    """CTEs taken (results inside the budget) and contexts (one row per query with results)."""
    return (
        hybrid_sql(k, queries)
        + f""",
summed AS (
  SELECT *, sum(length(content) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS tokens
  FROM hybrid WHERE score >= {least}),
taken AS (SELECT * FROM summed WHERE tokens <= {budget}),
contexts AS (
  SELECT s.query_id,
         coalesce(string_agg('[Source: ' || t.document_id || ']' || chr(10) || t.content,
                             chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY t.rank), '') AS context,
         CAST(count(t.rank) AS INTEGER) AS n_sources
  FROM summed s LEFT JOIN taken t ON s.query_id = t.query_id AND s.rank = t.rank
  GROUP BY s.query_id)"""
    )


def metadata_sql() -> str:
    return (
        """'{"doc_type":"transcription","lang":"' || lang || '","source":"' || source ||
           '","source_path":"' || source || '/' || document_id || '"}'"""
    )


TRADE_SQL = """
edges AS (
  SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, count(*) AS n_times
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
nodes AS (
  SELECT id, CAST(sum(n_times) AS BIGINT) AS n_times
  FROM (SELECT src AS id, n_times FROM edges UNION ALL SELECT dst, n_times FROM edges) GROUP BY id)"""
