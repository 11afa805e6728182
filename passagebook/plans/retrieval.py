"""Registered queries: embedding, index, search, ranking, context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.functions.text import keyword_score as keyword_column
from passagebook.functions.text import parse_metadata
from passagebook.functions.models import HashedWords, WordOverlap
from passagebook.functions.vectors import norm
from passagebook.operators import balls, digests, embedding, indexing, postings, quantised, ranking, search
from passagebook.operators.upsert import delete_keys, upsert
from passagebook.plans import inputs
from passagebook.sources.session import materialize, scratch_path


# ---- embedding -----------------------------------------------------------------------


def pending_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    chunks = inputs.document_table(spark, sf)
    return embedding.pending(chunks).select("chunk_id", "document_id")


def pending_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same against a separate embeddings table."""
    chunks = inputs.documents(spark, sf).select(
        F.col("document_id").alias("chunk_id"), F.lit(None).cast("array<float>").alias("embedding")
    )
    return embedding.pending(chunks, inputs.vectors(spark, sf)).select("chunk_id")


def embed_hash(spark: SparkSession, sf: str) -> DataFrame:
    """All documents embedded; the non-zero elements of every vector."""
    rows = embedding.embed(inputs.documents(spark, sf), inputs.embedder(), text="text", by="document_id")
    return (
        rows.select("document_id", F.posexplode("embedding").alias("bucket", "weight"))
        .filter(F.col("weight") != 0)
        .withColumn("weight", F.round(F.col("weight").cast("double"), 6))
    )


class LimitedWords(HashedWords):
    """A model that refuses texts above its input limit."""

    def __init__(self, dim: int, most_words: int):
        super().__init__(dim)
        self.most_words = most_words

    def embed(self, texts):
        for text in texts:
            if len(text.split()) > self.most_words:
                raise ValueError("text too long")
        return super().embed(texts)


def embed_retry(spark: SparkSession, sf: str) -> DataFrame:
    """A model with an input limit: long texts use up their tries and become error rows."""
    rows = embedding.embed(
        inputs.documents(spark, sf), LimitedWords(inputs.DIM, 300), text="text", batch_size=1, retry_delay=0.0,
        by="document_id",
    )
    return rows.groupBy(F.col("error").isNotNull().alias("failed")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("attempts").alias("attempts"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector"),
    )


def merge_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """New vectors by id, old ones kept: the old ones are the hashed words of the text."""
    old = embedding.embed(
        inputs.documents(spark, sf).withColumn("chunk_id", F.col("document_id")), inputs.embedder(), text="text"
    ).select("chunk_id", "embedding")
    merged = embedding.merge_embeddings(old, inputs.vectors(spark, sf))
    return merged.select(
        "chunk_id", F.size("embedding").alias("n_dims"), F.round(norm(F.col("embedding")), 4).alias("length")
    )


def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.with_token_count(inputs.documents(spark, sf), "text").select("document_id", "token_count")


def dim_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding.dimension_check(inputs.document_table(spark, sf), 64)
    return rows.select("chunk_id", "n_dims", "dim_ok")


def dim_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one label lose half their values and are set aside."""
    half = F.slice("embedding", 1, 32)
    rows = inputs.vectors(spark, sf).withColumn("embedding", F.when(F.col("label") == 3, half).otherwise(F.col("embedding")))
    return embedding.dimension_rejects(rows, 64)


# ---- index ---------------------------------------------------------------------------


def index_source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.source_stats(inputs.document_table(spark, sf))


def index_build(spark: SparkSession, sf: str) -> DataFrame:
    index = indexing.build_index(
        inputs.document_table(spark, sf), columns=["document_id", "chunk_index"]
    )
    return index.select(
        "chunk_id", "document_id", "chunk_index", F.size("embedding").alias("n_dims"),
        F.round(norm(F.col("embedding")), 5).alias("length"),
    )


def index_build_from_text(spark: SparkSession, sf: str) -> DataFrame:
    index = indexing.build_index_from_text(inputs.chunk_rows(spark, sf), inputs.embedder())
    return index.select(
        "chunk_id", "document_id", "chunk_index", F.round(norm(F.col("embedding")), 5).alias("length")
    )


def _nearer_another(centroids: np.ndarray, vector: Column, cell: Column) -> Column:
    """Whether a vector lies nearer another centroid than that of its cell, or has no cell."""

    @F.pandas_udf("boolean")
    def check(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for v, c in zip(vectors, cells):
            far = ((centroids - np.asarray(v, np.float64)) ** 2).sum(axis=1)
            out.append(not 0 <= c < len(far) or bool(far[int(c)] > far.min() + 1e-9))
        return pd.Series(out, dtype=bool)

    return check(vector, cell)


def index_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The index written by cell and read back: all rows of each label, each once, and in
    cells that exist and are nearest."""
    index = indexing.build_index(inputs.vectors(spark, sf), columns=["label"])
    centroids = indexing.train_cells(index, indexing.cell_count(index.count()))
    celled = search.write_cells(search.assign_cells(index, centroids), scratch_path(spark, "cells"))
    return celled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("chunk_id").alias("n_ids"),
        F.count_if(
            (F.col("cell") < 0) | (F.col("cell") >= len(centroids)) | _nearer_another(centroids, F.col("embedding"), F.col("cell"))
        ).alias("n_without_cell"),
    )


def _index_versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An index behind its source: labelled documents only, toxic ones in an old version,
    and the benchmark texts, which the source does not have."""
    docs = inputs.table(spark, sf, "documents").select(F.col("doc_id"), "text")
    labels = inputs.table(spark, sf, "labels")
    old = docs.join(labels, "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text")).alias("text"),
    )
    gone = inputs.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("chunk_id"), "text"
    )
    source = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    hashed = indexing.content_hash(["text"])
    return old.unionByName(gone).withColumn("content_hash", hashed), source.withColumn("content_hash", hashed)


def index_sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = indexing.key_difference(*_index_versions(spark, sf))
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("n_keys"))


def index_sync_apply(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.apply_sync(*_index_versions(spark, sf)).select("chunk_id", "text")


def index_sync_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a tree of hashes: only the buckets that differ are compared and written."""
    index, source = (digests.write(rows, scratch_path(spark, name), buckets=64) for rows, name in zip(_index_versions(spark, sf), ("synced", "source")))
    digests.sync(index, source)
    return index.rows().select("chunk_id", "text")


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.index_status(*_index_versions(spark, sf))


def index_delete(spark: SparkSession, sf: str) -> DataFrame:
    toxic = inputs.table(spark, sf, "labels").filter("toxic = 1")
    keys = toxic.select(F.col("doc_id").cast("string").alias("chunk_id"))
    return delete_keys(inputs.vectors(spark, sf), keys, "chunk_id").select("chunk_id", "label")


def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents written over the vectors of the same id, or added to them."""
    rows = inputs.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("chunk_id"), (F.col("quality") + 10).alias("label")
    )
    return upsert(inputs.vectors(spark, sf), rows, "chunk_id").select(
        "chunk_id", "label", F.col("embedding").isNotNull().alias("has_vector")
    )


# ---- search --------------------------------------------------------------------------


def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 nearest vectors of every vector."""
    return search.top_k(inputs.vector_queries(spark, sf), inputs.vectors(spark, sf), 10, columns=["label"])


def knn_exact_many(spark: SparkSession, sf: str) -> DataFrame:
    """The same on the shuffled way, which takes any number of queries."""
    return search.top_k(
        inputs.vector_queries(spark, sf), inputs.vectors(spark, sf), 10, columns=["label"], broadcast_queries=0
    )


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(
        inputs.vector_queries(spark, sf), inputs.vectors(spark, sf), 5, filters={"label": [1, 3, 5]}, columns=["label"]
    )


def recall_probes(cells: int) -> int:
    """Three cells in five: a fixed number would find ever less as cells grow with the rows."""
    return -(-3 * cells // 5)


def _ivf(spark: SparkSession, sf: str, probes: Callable[[int], int] | None) -> tuple[DataFrame, DataFrame]:
    """Exact rows, and those found in as many cells as `probes` says of their number, or in all."""
    index = inputs.vectors(spark, sf)
    centroids = indexing.train_cells(index, indexing.cell_count(index.count()))
    queries = inputs.vector_queries(spark, sf)
    celled = search.write_cells(search.assign_cells(index, centroids), scratch_path(spark, "cells"))
    near = search.top_k_cells(queries, celled, centroids, 10, probes(len(centroids)) if probes else len(centroids), columns=[])
    return search.top_k(queries, index, 10, columns=[]), near


def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """All cells probed: every exact row must be among them."""
    exact, near = _ivf(spark, sf, None)
    keys = ["query_id", "rank", "chunk_id", "score"]
    hit = near.select(*keys).withColumn("hit", F.lit(1))
    return exact.join(hit, keys, "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("hit").isNull()).alias("n_missing")
    )


def knn_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest three fifths of the cells hold at least 0.9 of the exact rows, with the same
    scores."""
    exact, near = _ivf(spark, sf, recall_probes)
    hit = near.select("query_id", "chunk_id", F.col("score").alias("hit"))
    return exact.join(hit, ["query_id", "chunk_id"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"),
        F.count_if(F.col("hit") != F.col("score")).alias("n_other_scores"),
    )


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as a query against all."""
    return inputs.vector_queries(spark, sf).filter(F.col("query_id").cast("long") % 50 == 0)


def knn_quantised(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of at most a tenth of the cells a query lead to at least 0.9 of the exact rows,
    with the same scores."""
    index, queries = inputs.vectors(spark, sf), _asked(spark, sf)
    quantiser = quantised.learn(index)
    copies = quantised.choose_copies(index, quantiser)
    codes = search.write_cells(quantised.encode(index, quantiser, copies), scratch_path(spark, "codes"))
    near = quantised.top_k(queries, index, codes, quantiser, 10)
    hit = near.select("query_id", "chunk_id", F.col("score").alias("hit"))
    read = search.ask_cells(queries, quantiser.centroids, quantiser.probes()).groupBy("query_id").count()
    share = read.agg((F.max("count") <= max(1.0, quantised.SHARE * quantiser.cells)).alias("cells_ok"))
    found = search.top_k(queries, index, 10, columns=[]).join(hit, ["query_id", "chunk_id"], "left").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"),
        F.count_if(F.col("hit") != F.col("score")).alias("n_other_scores"),
    )
    both = found.unionByName(share, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def knn_balls(spark: SparkSession, sf: str) -> DataFrame:
    """The exact 10 nearest vectors of every vector whose id is divisible by 50, by cells in
    the order of their bounds."""
    index = inputs.vectors(spark, sf)
    centres = indexing.train_cells(index, indexing.cell_count(index.count()))
    stored = balls.build(index, centres, scratch_path(spark, "balls"))
    return balls.top_k(_asked(spark, sf), stored, 10, columns=["label"])[0]


def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    """User turns scored against the reply that follows them."""
    turns = inputs.table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content")
    )
    return asked.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(keyword_column(F.col("query"), F.col("content")), 6).alias("score")
    )


def text_query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return search.embed_queries(inputs.text_queries(spark, sf), inputs.embedder())


def hybrid_results(spark: SparkSession, sf: str, least: float = 0.0, **options) -> DataFrame:
    return ranking.retrieve(
        text_query_vectors(spark, sf), inputs.text_index(spark, sf), inputs.FIXED, least=least, **options
    )


_RESULT = ("query_id", "rank", "score", "chunk_id", "document_id", "chunk_index")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_results(spark, sf).select(*_RESULT, "content")


def text_postings(spark: SparkSession, sf: str) -> postings.Postings:
    """The chunks of all documents by cell, and the inverted index of their words. Cells are
    learned from a sample of the chunks, embedded for it; then all are embedded and written once."""
    chunks = inputs.chunk_rows(spark, sf).select("chunk_id", "content")
    rows = max(1, int(inputs.table(spark, sf, "documents").agg(F.sum("n_chars")).first()[0] or 0) // inputs.STEP)
    some = chunks.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1000)) < 1000 * indexing.SAMPLE_ROWS / rows)
    sample = materialize(embedding.embed(some, inputs.embedder()).select("chunk_id", "embedding"), "postings-sample")
    centres = indexing.train_cells(sample, indexing.cell_count(rows))
    index = embedding.embed(chunks, inputs.embedder(), keep_text=True, spread=False).select("chunk_id", "content", "embedding")
    return postings.build(balls.build(index, centres, scratch_path(spark, "balls")), scratch_path(spark, "postings"))


def hybrid_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The best of all chunks by hybrid score, not only of the nearest by vector."""
    found, _ = postings.top_k(text_query_vectors(spark, sf), text_postings(spark, sf), 10)
    return found.select("query_id", "rank", "score", "chunk_id", "content")


def similarity_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_results(spark, sf, least=inputs.LEAST, use_hybrid=False).select(*_RESULT)


def batch_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid results over the threshold with their metadata, for all queries at once."""
    out = hybrid_results(spark, sf, least=inputs.LEAST)
    return out.select(
        "query_id", "rank", "chunk_id", F.col("metadata")["source_path"].alias("source_path"),
        F.col("metadata")["lang"].alias("lang"),
    )


def metadata_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as metadata; those of error events are cut short and give no keys."""
    broken = F.expr("substring(props, 1, length(props) - 1)")
    text = F.when(F.col("event_type") == "error", broken).otherwise(F.col("props"))
    parsed = inputs.table(spark, sf, "events").select("event_id", parse_metadata(text).alias("m"))
    return parsed.select("event_id", F.size("m").alias("n_keys"), F.col("m")["k"].alias("k"))


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    return hybrid_results(spark, sf, scorer=WordOverlap()).select(*_RESULT)


def context_window(spark: SparkSession, sf: str) -> DataFrame:
    packed = ranking.pack_context(hybrid_results(spark, sf, least=inputs.LEAST), inputs.CONTEXT_TOKENS)
    return packed.select("query_id", "context", "n_sources")


QUERIES = {
    f.__name__: f
    for f in (
        pending_embeddings, pending_by_table, embed_hash, embed_retry, merge_embeddings, token_count,
        dim_check, dim_rejects, index_source_stats, index_build, index_build_from_text, index_cells,
        index_sync_diff, index_sync_apply, index_sync_tree, index_status, index_delete, index_upsert, knn_exact, knn_exact_many,
        knn_filtered, knn_ivf, knn_ivf_recall, knn_quantised, knn_balls, keyword_score, hybrid_search, hybrid_exact, similarity_threshold,
        batch_retrieval, metadata_parse, rerank, context_window,
    )
}


def _knn_sql(k: int, where: str = "TRUE", asked: str = "TRUE") -> str:
    dot = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
    return f"""
WITH scored AS (
  SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(c.vec_id AS VARCHAR) AS chunk_id, c.label,
         round({dot}, 6) + 0.0 AS score
  FROM (SELECT * FROM embeddings WHERE {asked}) q, (SELECT * FROM embeddings WHERE {where}) c)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank,
       score, chunk_id, label
FROM scored QUALIFY rank <= {k}"""


_VERSIONS_SQL = """
WITH old AS (
  SELECT 'd' || doc_id AS chunk_id, CASE WHEN toxic = 1 THEN upper(text) ELSE text END AS text
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'b' || item_id, text FROM benchmark),
new AS (SELECT 'd' || doc_id AS chunk_id, text FROM documents),
diff AS (
  SELECT coalesce(old.chunk_id, new.chunk_id) AS chunk_id,
         CASE WHEN old.chunk_id IS NULL THEN 'insert' WHEN new.chunk_id IS NULL THEN 'delete'
              WHEN old.text = new.text THEN 'unchanged' ELSE 'update' END AS action
  FROM old FULL JOIN new ON old.chunk_id = new.chunk_id)"""

_R = "query_id, rank, score, chunk_id, document_id, chunk_index"

SQL = {
    "pending_embeddings": """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id FROM documents
WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "pending_by_table": """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
    "embed_hash": f"""
WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text FROM documents),
{inputs.hashed_sql("v", "document_id", "text", "docs")}
SELECT document_id, CAST(bucket AS INTEGER) AS bucket, round(weight, 6) AS weight FROM v""",
    "embed_retry": f"""
SELECT n > 300 AS failed, count(*) AS n_rows, CAST(sum(CASE WHEN n > 300 THEN 3 ELSE 1 END) AS BIGINT) AS attempts,
       count(*) FILTER (n > 300) AS without_vector
FROM (SELECT len({inputs.words_sql("text")}) AS n FROM documents) GROUP BY 1""",
    "merge_embeddings": f"""
SELECT CAST(doc_id AS VARCHAR) AS chunk_id,
       CAST(CASE WHEN vec_id IS NULL THEN {inputs.DIM} ELSE len(embedding) END AS INTEGER) AS n_dims,
       round(CASE WHEN vec_id IS NOT NULL THEN sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))
                  WHEN len({inputs.words_sql("text")}) = 0 THEN 0 ELSE 1 END, 4) AS length
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "token_count": f"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(len({inputs.words_sql("text")}) AS INTEGER) AS token_count
FROM documents""",
    "dim_check": """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, CAST(coalesce(len(embedding), 0) AS INTEGER) AS n_dims,
       coalesce(len(embedding), 0) = 64 AS dim_ok
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "dim_rejects": """
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CAST(32 AS INTEGER) AS n_dims, CAST(64 AS INTEGER) AS expected
FROM embeddings WHERE label = 3""",
    "index_cells": """
SELECT label, count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, CAST(0 AS BIGINT) AS n_without_cell
FROM embeddings GROUP BY label""",
    "knn_ivf_recall": """
SELECT count(*) * 10 AS n_rows, true AS recall_ok, CAST(0 AS BIGINT) AS n_other_scores FROM embeddings""",
    "index_source_stats": """
SELECT CASE WHEN t = 0 THEN 'no_data' WHEN e = 0 THEN 'no_embeddings' ELSE 'success' END AS status,
       t AS total_chunks, e AS embedded_chunks
FROM (SELECT count(*) AS t, count(vec_id) AS e FROM documents LEFT JOIN embeddings ON doc_id = vec_id)""",
    "index_build": """
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id, CAST(0 AS INTEGER) AS chunk_index,
       CAST(len(embedding) AS INTEGER) AS n_dims, CAST(1.0 AS DOUBLE) AS length
FROM documents JOIN embeddings ON doc_id = vec_id""",
    "index_build_from_text": f"""
WITH {inputs.CHUNKS_SQL}
SELECT chunk_id, document_id, chunk_index, CAST(1.0 AS DOUBLE) AS length FROM chunks""",
    "index_sync_diff": _VERSIONS_SQL + " SELECT action, count(*) AS n_keys FROM diff GROUP BY action",
    "index_sync_apply": "SELECT 'd' || doc_id AS chunk_id, text FROM documents",
    "index_sync_tree": "SELECT 'd' || doc_id AS chunk_id, text FROM documents",
    "index_status": _VERSIONS_SQL + """
SELECT count(*) FILTER (action = 'unchanged') AS covered, count(*) FILTER (action = 'insert') AS missing,
       count(*) FILTER (action = 'update') AS stale, count(*) FILTER (action = 'delete') AS orphaned,
       bool_and(action = 'unchanged') AS ready
FROM diff""",
    "index_delete": """
SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "index_upsert": """
SELECT CAST(coalesce(vec_id, doc_id) AS VARCHAR) AS chunk_id, coalesce(quality + 10, label) AS label,
       vec_id IS NOT NULL AS has_vector
FROM embeddings FULL JOIN labels ON vec_id = doc_id""",
    "knn_exact": _knn_sql(10),
    "knn_exact_many": _knn_sql(10),
    "knn_balls": _knn_sql(10, asked="vec_id % 50 = 0"),
    "knn_quantised": """
SELECT count(*) FILTER (vec_id % 50 = 0) * least(10, count(*)) AS n_rows, true AS recall_ok, CAST(0 AS BIGINT) AS n_other_scores,
       true AS cells_ok FROM embeddings""",
    "knn_filtered": _knn_sql(5, "label IN (1, 3, 5)"),
    "knn_ivf": """
SELECT count(*) * 10 AS n_rows, CAST(0 AS BIGINT) AS n_missing FROM embeddings""",
    "keyword_score": f"""
SELECT u.conv_id, u.turn,
       round(len(list_intersect({inputs.word_set_sql("u.text")}, {inputs.word_set_sql("a.text")}))
             / CAST(greatest(len({inputs.word_set_sql("u.text")}), 1) AS DOUBLE), 6) AS score
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
WHERE u.role = 'user' AND a.role = 'assistant'""",
    "hybrid_search": inputs.hybrid_sql() + f" SELECT {_R}, content FROM hybrid WHERE score >= 0",
    "hybrid_exact": inputs.hybrid_exact_sql(),
    "similarity_threshold": inputs.vector_search_sql(10) + f" SELECT {_R} FROM found WHERE score >= {inputs.LEAST}",
    "batch_retrieval": inputs.hybrid_sql() + f"""
SELECT query_id, rank, chunk_id, source || '/' || document_id AS source_path, lang
FROM hybrid WHERE score >= {inputs.LEAST}""",
    "metadata_parse": """
SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 0 ELSE len(json_keys(props)) END AS INTEGER) AS n_keys,
       CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS k
FROM events""",
    "rerank": inputs.hybrid_sql() + f""",
again AS (
  SELECT * EXCLUDE (score, rank), rank AS old_rank,
         round(2.0 * len(list_intersect({inputs.word_set_sql("query_text")}, {inputs.word_set_sql("content")}))
               / CAST(len({inputs.word_set_sql("query_text")}) + len({inputs.word_set_sql("content")}) AS DOUBLE), 6) AS score
  FROM hybrid WHERE score >= 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank) AS INTEGER) AS rank,
       score, chunk_id, document_id, chunk_index
FROM again""",
    "context_window": inputs.context_sql() + " SELECT query_id, context, n_sources FROM contexts",
}
