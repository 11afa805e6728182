"""Registered queries: validation, task metrics, streams, the full batch, graph tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.operators import graph, metrics, sketches, validation
from passagebook.plans import inputs, jobs
from passagebook.schemas import TASK_LOGS
from passagebook.settings import Settings
from passagebook.sources.session import scratch_path
from passagebook.streaming import ingest as stream

# Vectors must have 64 values and a length well above one half.
STRICT = Settings(embedding_dimension=64, min_embedding_norm=0.75)


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their vectors, of length one, but of length one half for each tenth id."""
    half = F.transform("embedding", lambda x: (x * F.lit(0.5)).cast("float"))
    short = F.col("chunk_id").cast("long") % 10 == 3
    return inputs.document_table(spark, sf).withColumn("embedding", F.when(short, half).otherwise(F.col("embedding")))


# ---- validation ----------------------------------------------------------------------

_ISSUE = ("row_id", "level", "field", "message")


def validate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate_chunks(_checked(spark, sf)).select(*_ISSUE, "value")


def validate_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return validation.validate_embeddings(_checked(spark, sf), STRICT).select(*_ISSUE)


def validate_transcriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as recordings; a limit of ten minutes marks the long ones."""
    rows = validation.validate_transcriptions(inputs.transcriptions(spark, sf), Settings(max_duration_seconds=600.0))
    return rows.select(*_ISSUE)


def chunk_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return validation.chunk_quality_report(_checked(spark, sf), STRICT)


def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return validation.embedding_coverage(_checked(spark, sf), STRICT)


def _all_issues(spark: SparkSession, sf: str) -> DataFrame:
    rows = _checked(spark, sf)
    return validation.validate_chunks(rows).unionByName(validation.validate_embeddings(rows, STRICT))


def issue_summary(spark: SparkSession, sf: str) -> DataFrame:
    return validation.issue_summary(_all_issues(spark, sf))


def issue_head(spark: SparkSession, sf: str) -> DataFrame:
    return validation.issue_head(_all_issues(spark, sf)).select(*_ISSUE)


def issue_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validation.errors(_all_issues(spark, sf)).select(*_ISSUE)


def issue_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return validation.warnings(_all_issues(spark, sf)).select(*_ISSUE)


def rag_data_report(spark: SparkSession, sf: str) -> DataFrame:
    return validation.rag_data_report(_checked(spark, sf), STRICT)


def report_by_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of two appended parts, labelled documents and the rest, merged to one report;
    whether distinct ids and the median length are within their bounds of the exact ones."""
    docs, labels = inputs.table(spark, sf, "documents"), inputs.table(spark, sf, "labels")
    target = scratch_path(spark, "profiles")
    length = F.length("text")
    for part, how in (("labelled", "left_semi"), ("rest", "left_anti")):
        rows = docs.join(labels, "doc_id", how)
        counts = {"n_short": length < 10, "n_chars": length}
        sketches.profile(rows, part, counts, ["doc_id"], {"length": length}).write.mode("append").parquet(target)
    kept = sketches.report(spark.read.parquet(target), (0.5,))
    exact = docs.agg(F.count_distinct("doc_id").alias("ids"), F.percentile(length, F.array(F.lit(0.45), F.lit(0.55))).alias("around"))
    both = kept.unionByName(exact, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select(
        "n_rows", "n_short", "n_chars", (F.abs(F.col("n_doc_id") / F.col("ids") - 1) <= 0.06).alias("distinct_ok"),
        F.col("length_p50").between(F.col("around")[0] - 1, F.col("around")[1] + 1).alias("median_ok"),
    )


# ---- task metrics --------------------------------------------------------------------


def task_log_append(spark: SparkSession, sf: str) -> DataFrame:
    """A run record for each of three scans, counted and appended in one job, and read back."""
    target = scratch_path(spark, "task-logs")
    scans = [
        inputs.table(spark, sf, name).agg(F.count(F.lit(1)).alias("records_processed")).select(
            F.lit(f"scan-{name}").alias("task_name"), F.lit(f"2024-01-31 00:0{i}:00").cast("timestamp").alias("run_timestamp"),
            F.lit(1.0).alias("duration_seconds"), F.lit("success").alias("status"), "records_processed",
        )
        for i, name in enumerate(("documents", "conversations", "pages"))
    ]
    metrics.run_records(reduce(DataFrame.unionByName, scans)).write.mode("append").parquet(target)
    return spark.read.schema(TASK_LOGS.struct()).parquet(target).select(
        "task_name", "status", "records_processed", "error_message", "logs"
    )


def recent_task_runs(spark: SparkSession, sf: str) -> DataFrame:
    reference = F.lit("2024-01-31 00:00:00").cast("timestamp")
    runs = metrics.recent_runs(inputs.task_logs(spark, sf), reference, 7)
    return runs.withColumn("run_timestamp", F.col("run_timestamp").cast("timestamp_ntz"))


def task_metric_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_rollup(inputs.task_logs(spark, sf))


# ---- full batch and streams ----------------------------------------------------------


def full_batch_run(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs in order, on tables of their own: ingest, embed and index; the index by document."""
    name = "run_" + scratch_path(spark, "run").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name}")
    tables = jobs.Tables(name)
    tables.transcriptions = f"{name}_transcriptions"
    inputs.transcriptions(spark, sf).createOrReplaceTempView(tables.transcriptions)
    jobs.full_batch(spark, tables, inputs.FIXED, inputs.embedder(), datetime(2024, 1, 1))
    return spark.table(tables.index).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(F.length("content")).alias("n_chars"),
        F.min("chunk_id").alias("first_id"),
        F.sum(F.size("embedding")).alias("n_values"),
    )


def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = inputs.table(spark, sf, "documents").schema
    return inputs.as_transcriptions(stream.read_files(spark, sf, schema, pattern="documents.parquet"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """New files as a stream, chunked batch by batch. Each document is delivered twice in a
    batch; a second run finds nothing new."""
    target, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    twice = _document_stream(spark, sf).unionByName(_document_stream(spark, sf))
    for _ in range(2):
        stream.ingest_stream(twice, target, state, inputs.created_at(), inputs.FIXED).awaitTermination()
    rows = spark.read.parquet(f"{target}/chunks")
    return rows.select("document_id", "chunk_index", "chunk_id", "start_char", "end_char")


def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    """The stream through all stages: the index rows its batches wrote, by document."""
    target, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    stream.ingest_stream(
        _document_stream(spark, sf), target, state, inputs.created_at(), inputs.FIXED, inputs.embedder()
    ).awaitTermination()
    return spark.read.parquet(f"{target}/index").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_id")
    )


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every event delivered twice; each is kept once."""
    target, state = scratch_path(spark, "events"), scratch_path(spark, "events-state")
    schema = inputs.table(spark, sf, "events").schema

    def delivery():
        return stream.read_files(spark, sf, schema, pattern="events.parquet")

    both = delivery().unionByName(delivery()).select("event_id", "ts", "user_id", "event_type", "value")
    stream.start(stream.first_deliveries(both, "event_id"), stream.write_rows(target), state).awaitTermination()
    rows = spark.read.parquet(target).select("event_id", "ts", "user_id", "event_type", "value")
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# ---- graph tables --------------------------------------------------------------------


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    edges = inputs.trade_edges(spark, sf)
    return graph.graph_stats(inputs.trade_nodes(edges), edges)


def graph_filter(spark: SparkSession, sf: str) -> DataFrame:
    edges = inputs.trade_edges(spark, sf)
    nodes = graph.with_confidence(inputs.trade_nodes(edges))
    _, kept = graph.graph_filter(nodes, graph.with_confidence(edges))
    return kept.select("src", "dst", "n_times", F.round("confidence", 6).alias("confidence"))


def k_hop(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from the suppliers in debt."""
    seeds = inputs.table(spark, sf, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")
    )
    return graph.k_hop(inputs.trade_edges(spark, sf), seeds, 3)


def k_hop_many(spark: SparkSession, sf: str) -> DataFrame:
    """Two steps from each supplier in debt by itself."""
    seeds = inputs.table(spark, sf, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")
    )
    return graph.k_hop_many(inputs.trade_edges(spark, sf), seeds, 2)


def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.entity_mentions(inputs.table(spark, sf, "pages"), "page_id", "html")
    return rows.groupBy("page_id", "entity_type", "entity").agg(F.count(F.lit(1)).alias("n_times"))


def co_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that share a chunk, over the chunks of all documents."""
    edges = graph.with_confidence(graph.relations(inputs.chunk_rows(spark, sf)))
    return edges.select("src", "dst", "n_times", F.round("confidence", 6).alias("confidence"))


def graph_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The node table, with the number of relations of each node."""
    chunks = inputs.chunk_rows(spark, sf)
    nodes, edges = graph.graph_tables(graph.entity_mentions(chunks), graph.relations(chunks))
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(degree, "id", "left").select(
        "id", "group", "n_times", F.round("confidence", 6).alias("confidence"),
        F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        validate_chunks, validate_embeddings, validate_transcriptions, chunk_quality_report,
        embedding_coverage, issue_summary, issue_head, issue_errors, issue_warnings, rag_data_report, report_by_parts,
        task_log_append, recent_task_runs, task_metric_rollup, full_batch_run, stream_ingest, stream_index,
        stream_dedupe, graph_stats, graph_filter, k_hop, k_hop_many, entity_mentions, co_mentions, graph_tables,
    )
}

_ROWS = """
halved AS (
  SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN list_transform(embedding, lambda x: CAST(x * 0.5 AS FLOAT)) ELSE embedding END AS embedding
  FROM embeddings),
rows AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS document_id, text AS content, embedding,
         length(text) AS n, len(embedding) AS dims,
         sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm
  FROM documents LEFT JOIN halved ON doc_id = vec_id)"""


def _rule(where: str, level: str, field: str, message: str, value: str = "CAST(NULL AS VARCHAR)", row: str = "chunk_id", source: str = "rows") -> str:
    return (
        f"SELECT coalesce({row}, 'unknown') AS row_id, '{level}' AS level, '{field}' AS field, "
        f"{message} AS message, {value} AS value FROM {source} WHERE {where}"
    )


_CHUNK_ISSUES = "chunk_issues AS (" + " UNION ALL ".join(
    [
        _rule(f"coalesce({c}, '') = ''", "error", c, f"'Missing required field: {c}'")
        for c in ("chunk_id", "document_id", "content")
    ]
    + [
        _rule("n > 0 AND n < 10", "warning", "content", "'Content too short (' || n || ' chars)'", "CAST(n AS VARCHAR)"),
        _rule("n > 10000", "warning", "content", "'Content too long (' || n || ' chars)'", "CAST(n AS VARCHAR)"),
        _rule(f"n > 0 AND trim(content, {inputs.SPACE_SQL}) = ''", "error", "content", "'Content is empty or whitespace-only'"),
    ]
) + ")"

_BAD = "len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0"
_VECTOR_ISSUES = "vector_issues AS (" + " UNION ALL ".join(
    [
        _rule("coalesce(dims, 0) = 0", "error", "embedding", "'Embedding is null or empty'"),
        _rule("dims > 0 AND dims <> 64", "error", "embedding", "'Wrong embedding dimension: ' || dims || ', expected 64'"),
        _rule("dims > 0 AND NOT isnan(norm) AND norm < 0.75", "warning", "embedding", "'Embedding norm too small: ' || printf('%.4f', norm)"),
        _rule("dims > 0 AND NOT isnan(norm) AND norm > 100.0", "warning", "embedding", "'Embedding norm too large: ' || printf('%.4f', norm)"),
        _rule(f"dims > 0 AND {_BAD}", "error", "embedding", "'Embedding contains NaN or Inf values'"),
    ]
) + ")"

_BOTH = f"WITH {_ROWS}, {_CHUNK_ISSUES}, {_VECTOR_ISSUES}, both_issues AS (SELECT * FROM chunk_issues UNION ALL SELECT * FROM vector_issues)"

# Rows with their issue counts: chunk rules on all, vector rules on rows with a vector.
_COUNTED = _BOTH + """,
counted AS (
  SELECT r.chunk_id, coalesce(r.dims, 0) > 0 AS there,
         (SELECT count(*) FROM chunk_issues i WHERE i.row_id = r.chunk_id) AS chunk_n,
         (SELECT count(*) FROM chunk_issues i WHERE i.row_id = r.chunk_id AND level = 'error') AS chunk_errors,
         (SELECT count(*) FROM vector_issues i WHERE i.row_id = r.chunk_id) AS vector_n,
         (SELECT count(*) FROM vector_issues i WHERE i.row_id = r.chunk_id AND level = 'error') AS vector_errors
  FROM rows r),
chunk_report AS (
  SELECT 'chunks' AS report, count(*) AS total_records, count(*) AS checked_records,
         count(*) FILTER (NOT bad) AS valid_records, count(*) FILTER (bad) AS invalid_records,
         CAST(sum(n) AS BIGINT) AS issue_count, NOT bool_or(bad) AS is_valid
  FROM (SELECT chunk_errors > 0 OR (there AND vector_errors > 0) AS bad,
               chunk_n + CASE WHEN there THEN vector_n ELSE 0 END AS n FROM counted)),
vector_report AS (
  SELECT 'embeddings' AS report, total AS total_records, embedded AS checked_records,
         good AS valid_records, embedded - good AS invalid_records,
         CAST(n + CASE WHEN coverage < 0.9 THEN 1 ELSE 0 END AS BIGINT) AS issue_count,
         good = embedded AS is_valid, embedded AS embedded_records, coverage
  FROM (SELECT count(*) AS total, count(*) FILTER (there) AS embedded,
               count(*) FILTER (there AND vector_errors = 0) AS good,
               coalesce(sum(vector_n) FILTER (there), 0) AS n,
               count(*) FILTER (there) / CAST(count(*) AS DOUBLE) AS coverage FROM counted))"""

_TRANSCRIPT_ISSUES = " UNION ALL ".join(
    [
        _rule(f"coalesce({c}, '') = ''", "error", c, f"'Missing required field: {c}'", row="transcription_id", source="t")
        for c in ("transcription_id", "text")
    ]
    + [
        _rule("length(text) > 0 AND length(text) < 10", "warning", "text", "'Transcription text is very short'", row="transcription_id", source="t"),
        _rule("duration_seconds <= 0", "error", "duration_seconds", "'Duration must be positive'", row="transcription_id", source="t"),
        _rule("duration_seconds > 600", "warning", "duration_seconds", "'Duration unusually long'", row="transcription_id", source="t"),
    ]
)

_I = "row_id, level, field, message"

_MENTIONS = r"""
SELECT {key}, 'DATE' AS entity_type, unnest(regexp_extract_all({text}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS entity FROM {source}
UNION ALL
SELECT {key}, 'CONCEPT', unnest(regexp_extract_all({text}, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) FROM {source}"""

_RELATIONS = inputs.CHUNKS_SQL + """,
lists AS (
  SELECT list_sort(list_distinct(list_concat(
           regexp_extract_all(content, '[0-9]{4}-[0-9]{2}-[0-9]{2}'),
           regexp_extract_all(content, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')))) AS m
  FROM chunks),
pairs AS (
  SELECT m[i] AS src, unnest(m[i + 1 : len(m)]) AS dst FROM (SELECT m, unnest(range(1, len(m))) AS i FROM lists)),
relations AS (SELECT src, dst, count(*) AS n_times FROM pairs GROUP BY ALL)"""

SQL = {
    "validate_chunks": f"WITH {_ROWS}, {_CHUNK_ISSUES} SELECT {_I}, value FROM chunk_issues",
    "validate_embeddings": f"WITH {_ROWS}, {_VECTOR_ISSUES} SELECT {_I} FROM vector_issues",
    "validate_transcriptions": f"WITH t AS ({inputs.TRANSCRIPTIONS_SQL}) SELECT {_I} FROM ({_TRANSCRIPT_ISSUES})",
    "chunk_quality_report": _COUNTED + " SELECT * FROM chunk_report",
    "embedding_coverage": _COUNTED + " SELECT * FROM vector_report",
    "issue_summary": _BOTH + " SELECT level, field, count(*) AS n_issues FROM both_issues GROUP BY ALL",
    "issue_head": _BOTH + f" SELECT {_I} FROM both_issues ORDER BY row_id, field, level, message LIMIT 100",
    "issue_errors": _BOTH + f" SELECT {_I} FROM both_issues WHERE level = 'error'",
    "issue_warnings": _BOTH + f" SELECT {_I} FROM both_issues WHERE level = 'warning'",
    "rag_data_report": _COUNTED + """
SELECT *, CAST(NULL AS BIGINT) AS embedded_records, CAST(NULL AS DOUBLE) AS coverage FROM chunk_report
UNION ALL SELECT * FROM vector_report""",
    "report_by_parts": """
SELECT count(*) AS n_rows, count(*) FILTER (length(text) < 10) AS n_short, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       true AS distinct_ok, true AS median_ok FROM documents""",
    "task_log_append": " UNION ALL ".join(
        f"SELECT 'scan-{t}' AS task_name, 'success' AS status, count(*) AS records_processed, "
        f"CAST(NULL AS VARCHAR) AS error_message, '[]' AS logs FROM {t}"
        for t in ("documents", "conversations", "pages")
    ),
    "recent_task_runs": """
SELECT 'user-' || user_id AS task_name, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CAST(1 AS BIGINT) AS records_processed, value AS duration_seconds, ts AS run_timestamp
FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS""",
    "task_metric_rollup": """
WITH runs AS (
  SELECT 'user-' || user_id AS task_name, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed_runs
  FROM events GROUP BY 1),
sums AS (
  SELECT 'user-' || user_id AS task_name, 'k' AS metric,
         sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1)
SELECT task_name, metric, total, runs, failed_runs, failed_runs / CAST(runs AS DOUBLE) AS failure_rate
FROM runs LEFT JOIN sums USING (task_name)""",
    "full_batch_run": f"""
WITH {inputs.CHUNKS_SQL}
SELECT document_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars,
       min(chunk_id) AS first_id, count(*) * {inputs.DIM} AS n_values
FROM chunks GROUP BY document_id""",
    "stream_ingest": f"WITH {inputs.CHUNKS_SQL} SELECT document_id, chunk_index, chunk_id, start_char, end_char FROM chunks",
    "stream_index": f"""
WITH {inputs.CHUNKS_SQL} SELECT document_id, count(*) AS n_chunks, min(chunk_id) AS first_id FROM chunks GROUP BY document_id""",
    "stream_dedupe": "SELECT event_id, ts, user_id, event_type, value FROM events",
    "graph_stats": f"""
WITH {inputs.TRADE_SQL}
SELECT n AS n_nodes, e AS n_edges, e / CAST(n * (n - 1) AS DOUBLE) AS density
FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)""",
    "graph_filter": f"""
WITH {inputs.TRADE_SQL}, sure AS (SELECT id FROM nodes WHERE n_times / (n_times + 1.0) >= 0.7)
SELECT src, dst, n_times, round(n_times / CAST(n_times + 1 AS DOUBLE), 6) AS confidence FROM edges
WHERE n_times / (n_times + 1.0) >= 0.6 AND src IN (FROM sure) AND dst IN (FROM sure)""",
    "k_hop": f"""
WITH RECURSIVE {inputs.TRADE_SQL},
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
steps AS (
  SELECT 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_acctbal < 0
  UNION
  SELECT dst, hop + 1 FROM steps JOIN both_ways ON src = node WHERE hop < 3)
SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM steps GROUP BY node""",
    "k_hop_many": f"""
WITH RECURSIVE {inputs.TRADE_SQL},
both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
steps AS (
  SELECT 's' || s_suppkey AS seed, 's' || s_suppkey AS node, 0 AS hop FROM supplier WHERE s_acctbal < 0
  UNION
  SELECT seed, dst, hop + 1 FROM steps JOIN both_ways ON src = node WHERE hop < 2)
SELECT seed, node, CAST(min(hop) AS INTEGER) AS hop FROM steps GROUP BY seed, node""",
    "entity_mentions": "SELECT page_id, entity_type, entity, count(*) AS n_times FROM ("
    + _MENTIONS.format(key="page_id", text="html", source="pages")
    + ") GROUP BY ALL",
    "co_mentions": f"""
WITH {_RELATIONS}
SELECT src, dst, n_times, round(n_times / CAST(n_times + 1 AS DOUBLE), 6) AS confidence FROM relations""",
    "graph_tables": f"""
WITH {_RELATIONS},
mentions AS ({_MENTIONS.format(key="chunk_id", text="content", source="chunks")}),
nodes AS (SELECT entity AS id, min(entity_type) AS "group", count(*) AS n_times FROM mentions GROUP BY entity),
degree AS (
  SELECT id, count(*) AS degree FROM (SELECT src AS id FROM relations UNION ALL SELECT dst FROM relations) GROUP BY id)
SELECT id, "group", n_times, round(n_times / CAST(n_times + 1 AS DOUBLE), 6) AS confidence,
       coalesce(degree, 0) AS degree
FROM nodes LEFT JOIN degree USING (id)""",
}
