"""Registered queries: tables, upsert, chunking, ingestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.functions.text import document_id, parse_metadata, strip
from passagebook.operators import chunking, ingest, ledger, upsert
from passagebook.plans import inputs
from passagebook.schemas import DOCUMENT_CHUNKS, TASK_LOGS, TRANSCRIPTIONS, TableSchema, conform
from passagebook.sources import files, tables
from passagebook.sources.session import materialize, scratch_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def scan_transcriptions(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.transcriptions(spark, sf)


def append_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends, labelled documents and the rest, read back as one table."""
    source, labels = inputs.transcriptions(spark, sf), inputs.table(spark, sf, "labels")
    ids = labels.select(F.col("doc_id").cast("string").alias("transcription_id"))
    target = scratch_path(spark, "chunks")
    for how in ("left_semi", "left_anti"):
        rows = ingest.ingest(source.join(ids, "transcription_id", how), inputs.created_at(), inputs.FIXED)
        rows.write.mode("append").parquet(target)
    return spark.read.schema(DOCUMENT_CHUNKS.struct()).parquet(target).drop("embedding")


PARTED = TableSchema(TRANSCRIPTIONS.columns, ("language",))


def typed_table(spark: SparkSession, sf: str) -> DataFrame:
    """A declared table, partitioned by language, filled by append and scanned."""
    target = scratch_path(spark, "typed")
    name = "t_" + target.rsplit("-", 1)[1]
    tables.create_table(spark, name, PARTED, "Transcribed text", {"origin": "documents"}, target)
    tables.append(inputs.transcriptions(spark, sf), name, PARTED)
    return spark.table(name).select("transcription_id", "language", "duration_seconds", "metadata")


def schema_conform(spark: SparkSession, sf: str) -> DataFrame:
    rows = conform(inputs.task_logs(spark, sf), TASK_LOGS)
    return rows.withColumn("run_timestamp", F.col("run_timestamp").cast("timestamp_ntz"))


def upsert_all(spark: SparkSession, sf: str) -> DataFrame:
    source = inputs.table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit(0).alias("toxic")
    )
    return upsert.upsert(inputs.table(spark, sf, "labels"), source, "doc_id")


def upsert_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Orders take the price of their newest line; several lines share an order key."""
    target = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    source = inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linestatus").alias("o_orderstatus"),
        F.col("l_extendedprice").alias("o_totalprice"),
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
    )
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    return upsert.upsert(target, source, "o_orderkey", ["o_totalprice"], order)


def table_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table_stats(spark, sf).select("table_name", "row_count", "num_files")


def table_stats(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        tables.table_stats(inputs.table(spark, sf, t)).select(F.lit(t).alias("table_name"), "*") for t in TABLES
    ]
    return reduce(DataFrame.unionAll, parts)


def compact_zorder(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "zorder")
    lines = inputs.table(spark, sf, "lineitem")
    tables.zorder(lines, ["l_orderkey", "l_shipdate"], target, rows_per_file=100_000)
    return spark.read.schema(lines.schema).parquet(target)


def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Texts landed as files in a folder for each source, listed without reading them, beside
    what the table says they hold: a line feed ends each text."""
    docs = inputs.table(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("text"))
    folder = scratch_path(spark, "landing")
    # By source, but one that holds many texts is spread over several writers.
    docs.hint("rebalance", "source").write.partitionBy("source").text(folder)
    listed = files.file_inventory(spark, folder, ("txt",)).withColumn("source", F.regexp_extract("path", "/source=([^/]+)/", 1))
    found = listed.groupBy("source").agg(F.sum("size_bytes").alias("n_bytes"), F.max("modified_at").isNotNull().alias("has_time"))
    held = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    return held.join(found, "source", "left").select("source", "n_documents", "n_bytes", "has_time")


def incremental_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = inputs.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    return ingest.new_documents(inputs.transcriptions(spark, sf), done).select("transcription_id", "audio_file_path")


def ledger_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a ledger of four runs, of which only those are read that may hold an id."""
    path = scratch_path(spark, "ledger")
    done = inputs.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("doc_id") % 4).alias("run"))
    for run in range(4):
        ledger.add(done.filter(F.col("run") == run), path, f"run-{run}")
    return ledger.unseen(inputs.transcriptions(spark, sf), path).select("transcription_id", "audio_file_path")


def _chunks(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    return chunking.chunk(inputs.documents(spark, sf), strategy=strategy, size=inputs.SIZE, overlap=inputs.OVERLAP)


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "fixed").select("document_id", "chunk_index", "start_char", "end_char", "content")


def chunk_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "sentence").select("document_id", "chunk_index", "start_char", "end_char", "content")


def chunk_hard(spark: SparkSession, sf: str) -> DataFrame:
    out = chunking.hard_windows(inputs.documents(spark, sf), "text", inputs.SIZE, inputs.OVERLAP)
    return out.select("document_id", "chunk_index", "start_char", "end_char", "content")


def _squeezed(text):
    return F.regexp_replace(text, "[.!? \\t\\n\\r\\x0B\\f]", "")


def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that must hold for every document: no chunk too long, none off its offset,
    no gap in the numbers, none blank, and no letter lost or doubled."""
    docs = inputs.documents(spark, sf)
    # Hard windows overlap, so letters are counted without them.
    chunks = materialize(chunking.recursive_chunks(docs, "text", inputs.SIZE, 0), "recursive")
    numbers = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("chunk_index").alias("last"),
        F.countDistinct("chunk_index").alias("different"),
    )
    parts = [
        docs.agg(
            F.count(F.lit(1)).alias("n_documents"),
            F.sum(F.length(_squeezed(F.col("text")))).alias("letters_in_text"),
        ),
        chunks.agg(
            F.count_if(F.length("content") > inputs.SIZE).alias("too_long"),
            F.count_if(strip(F.col("content")) == "").alias("blank"),
            F.coalesce(F.sum(F.length(_squeezed(F.col("content")))), F.lit(0)).cast("bigint").alias("letters_in_chunks"),
        ),
        numbers.agg(
            F.count_if((F.col("last") + 1 != F.col("n")) | (F.col("different") != F.col("n"))).alias("bad_numbers")
        ),
        chunking.offset_check(chunks, docs).agg(F.count_if(~F.col("at_offset")).alias("off_text")),
    ]
    names = [c for part in parts for c in part.columns]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return together.agg(*[F.max(c).alias(c) for c in names])


def chunk_recursive_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "recursive").select(
        "document_id", "chunk_index", "chunk_id", "start_char", "end_char", "content"
    )


def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "fixed").select("document_id", "chunk_index", "chunk_id")


def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    pages = inputs.table(spark, sf, "pages")
    return pages.select("url", document_id(F.col("url")).alias("document_id"))


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Pages carry their own doc_type, which wins; documents keep the given one."""
    source = inputs.table(spark, sf, "documents")
    own = F.when(
        F.col("lang") == "en",
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("doc_type"), F.col("source")),
    ).otherwise(F.create_map(F.lit("lang"), F.col("lang")))
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    merged = ingest.chunk_metadata(path, F.lit("transcription"), own)
    back = parse_metadata(ingest.metadata_json(merged))
    return source.select("doc_id", back.alias("m")).select(
        "doc_id",
        F.size("m").alias("n_keys"),
        F.col("m")["source_path"].alias("source_path"),
        F.col("m")["doc_type"].alias("doc_type"),
        F.col("m")["lang"].alias("lang"),
    )


def chunk_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence chunks that are the text at their offset, and those that are not because
    spaces were collapsed."""
    docs = inputs.documents(spark, sf)
    checked = chunking.offset_check(_chunks(spark, sf, "sentence"), docs)
    return checked.groupBy("at_offset").agg(F.count(F.lit(1)).alias("n_chunks"))


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and chunks of a run, counted while the chunks are written."""
    done = inputs.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("document_id"))
    fresh = ingest.new_documents(inputs.transcriptions(spark, sf), done)
    target = scratch_path(spark, "chunks")
    stats = ingest.ingest_counted(fresh, inputs.created_at(), lambda chunks: chunks.write.parquet(target), inputs.FIXED)
    return spark.createDataFrame([tuple(stats.values())], "status string, documents_processed long, chunks_created long")


QUERIES = {
    f.__name__: f
    for f in (
        scan_transcriptions, append_chunks, typed_table, schema_conform, upsert_all, upsert_columns,
        table_row_counts, table_stats, compact_zorder, file_inventory, incremental_anti_join, ledger_anti_join,
        chunk_fixed, chunk_sentence, chunk_hard, chunk_recursive, chunk_recursive_rows, chunk_ids,
        document_ids, chunk_metadata, chunk_offsets, ingest_stats,
    )
}

_CHUNK_COLUMNS = "document_id, chunk_index, start_char, end_char, content"

# One step per sentence: pack it, or close the chunk and open the next. `at` is where the
# closed chunk was found, or 0.
_SENTENCE_SQL = f"""docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS document_id, text, {inputs.sentences_sql("text")} AS s FROM documents),
pack AS (
  SELECT document_id, text, s, 0 AS i, '' AS cur, CAST(NULL AS VARCHAR) AS closed, 0 AS n, 0 AS pos FROM docs
  UNION ALL
  SELECT document_id, text, s, i + 1,
         CASE WHEN fits THEN trim(cur || ' ' || sentence, {inputs.SPACE_SQL}) ELSE sentence END,
         CASE WHEN NOT fits AND cur <> '' THEN cur END,
         CASE WHEN NOT fits AND cur <> '' THEN n + 1 ELSE n END,
         CASE WHEN NOT fits AND cur <> '' THEN
           (CASE WHEN hit > 0 THEN base + hit - 1 ELSE pos END) + length(cur) ELSE pos END
  FROM (SELECT *, s[i + 1] AS sentence, length(cur) + length(s[i + 1]) + 1 <= {inputs.SIZE} AND i < len(s) AS fits,
               greatest(0, pos - {inputs.OVERLAP}) AS base,
               instr(substr(text, greatest(0, pos - {inputs.OVERLAP}) + 1), cur) AS hit
        FROM pack WHERE i <= len(s))),
sentence_chunks AS (
SELECT document_id, CAST(n - 1 AS INTEGER) AS chunk_index, CAST(pos - length(closed) AS INTEGER) AS start_char,
       CAST(pos AS INTEGER) AS end_char, closed AS content
FROM pack WHERE closed IS NOT NULL)"""



def _recursive_sql() -> str:
    """CTEs that split by one separator after the other, ending in recursive_chunks.

    A fold walks the parts of a long span with the open run [s, e): a part that fits extends
    the run; otherwise the run [rs, re) is closed, and a part too long by itself [ps, pe)
    is handed to the next separator.
    """
    size, step = inputs.SIZE, inputs.STEP
    ctes = ["spans0 AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS lo, text AS body FROM documents)"]
    for level, sep in enumerate(chunking.SEPARATORS):
        text = " || ".join({"\n": "chr(10)", "\t": "chr(9)"}.get(c, f"'{c}'") for c in sep)
        none = ", ".join(f"CAST(NULL AS BIGINT) AS {c}" for c in ("rs", "re", "ps", "pe"))
        ctes.append(f"""
fold{level} AS (
  SELECT document_id, lo, body, string_split(body, {text}) AS p, 0 AS i, CAST(0 AS BIGINT) AS pos,
         CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS e, {none}
  FROM spans{level} WHERE length(body) > {size}
  UNION ALL
  SELECT document_id, lo, body, p, i + 1, pend + {len(sep)},
         CASE WHEN last THEN pend WHEN fits THEN s0 WHEN long THEN pend ELSE pos END, pend,
         CASE WHEN (last OR NOT fits) AND e0 > s0 THEN s0 END, CASE WHEN (last OR NOT fits) AND e0 > s0 THEN e0 END,
         CASE WHEN NOT last AND long THEN pos END, CASE WHEN NOT last AND long THEN pend END
  FROM (SELECT *, i = len(p) AS last, pos + coalesce(length(p[i + 1]), 0) AS pend,
               coalesce(length(p[i + 1]), 0) > {size} AS long,
               pos + coalesce(length(p[i + 1]), 0) - s0 <= {size} AS fits
        FROM (SELECT *, CASE WHEN s = e AND i < len(p) THEN pos ELSE s END AS s0,
                     CASE WHEN s = e AND i < len(p) THEN pos ELSE e END AS e0 FROM fold{level} WHERE i <= len(p)))),
spans{level + 1} AS (
  SELECT document_id, lo + rs AS lo, substr(body, rs + 1, re - rs) AS body FROM fold{level} WHERE rs IS NOT NULL
  UNION ALL
  SELECT document_id, lo + ps, substr(body, ps + 1, pe - ps) FROM fold{level} WHERE ps IS NOT NULL)""")
    last = len(chunking.SEPARATORS)
    short = " UNION ALL ".join(f"SELECT * FROM spans{n} WHERE length(body) <= {size}" for n in range(last + 1))
    ctes.append(f"""
pieces AS (
  {short}
  UNION ALL
  SELECT document_id, lo + k, substr(body, k + 1, {size})
  FROM (SELECT *, unnest(range(0, length(body), {step})) AS k FROM spans{last} WHERE length(body) > {size})),
recursive_chunks AS (
  SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY lo) - 1 AS INTEGER) AS chunk_index,
         CAST(lo + length(body) - length(ltrim(body, {inputs.SPACE_SQL})) AS INTEGER) AS start_char,
         trim(body, {inputs.SPACE_SQL}) AS content
  FROM pieces WHERE trim(body, {inputs.SPACE_SQL}) <> '')""")
    return ",".join(ctes)


SQL = {
    "scan_transcriptions": inputs.TRANSCRIPTIONS_SQL,
    "append_chunks": f"""
WITH {inputs.CHUNKS_SQL}
SELECT chunk_id, document_id, content, chunk_index, start_char, end_char, {inputs.metadata_sql()} AS metadata,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM chunks""",
    "typed_table": f"SELECT transcription_id, language, duration_seconds, metadata FROM ({inputs.TRANSCRIPTIONS_SQL})",
    "schema_conform": """
SELECT 'user-' || user_id AS task_name, ts AS run_timestamp, value AS duration_seconds,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
       CAST(1 AS BIGINT) AS records_processed, CAST(event_type = 'error' AS BIGINT) AS records_failed,
       props AS metrics, CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS VARCHAR) AS logs
FROM events""",
    "upsert_all": """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id,
       CASE WHEN d.doc_id IS NULL THEN l.quality ELSE CAST(d.n_chars > 500 AS INTEGER) END AS quality,
       CASE WHEN d.doc_id IS NULL THEN l.toxic ELSE 0 END AS toxic
FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id""",
    "upsert_columns": """
WITH newest AS (
  SELECT l_orderkey, l_linestatus, l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1)
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey,
       CASE WHEN o_orderkey IS NULL THEN l_linestatus ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN l_orderkey IS NULL THEN o_totalprice ELSE l_extendedprice END AS o_totalprice
FROM orders FULL JOIN newest ON o_orderkey = l_orderkey""",
    "table_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST(1 AS BIGINT) AS num_files FROM {t}" for t in TABLES
    ),
    "compact_zorder": "SELECT * FROM lineitem",
    "incremental_anti_join": f"""
SELECT transcription_id, audio_file_path FROM ({inputs.TRANSCRIPTIONS_SQL})
WHERE transcription_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "file_inventory": """
SELECT source, count(*) AS n_documents, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes, true AS has_time
FROM documents GROUP BY source""",
    "ledger_anti_join": f"""
SELECT transcription_id, audio_file_path FROM ({inputs.TRANSCRIPTIONS_SQL})
WHERE transcription_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "chunk_fixed": f"WITH {inputs.CHUNKS_SQL} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunk_sentence": f"WITH RECURSIVE {_SENTENCE_SQL} SELECT * FROM sentence_chunks",
    "chunk_hard": "WITH "
    + inputs.windows_sql(f"ceil(length(text) / CAST({inputs.STEP} AS DOUBLE))", f"substr(text, k * {inputs.STEP} + 1, {inputs.SIZE})")
    + f" SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunk_recursive": r"""
SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS off_text,
       CAST(0 AS BIGINT) AS blank, CAST(0 AS BIGINT) AS bad_numbers,
       CAST(sum(length(regexp_replace(text, '[.!? \t\n\r\x0b\x0c]', '', 'g'))) AS BIGINT) AS letters_in_text,
       CAST(sum(length(regexp_replace(text, '[.!? \t\n\r\x0b\x0c]', '', 'g'))) AS BIGINT) AS letters_in_chunks
FROM documents""",
    "chunk_recursive_rows": f"""
WITH RECURSIVE {_recursive_sql()}
SELECT document_id, chunk_index, substr(sha256(document_id || ':' || chunk_index || ':' || substr(content, 1, 100)), 1, 16)
       AS chunk_id, start_char, CAST(start_char + length(content) AS INTEGER) AS end_char, content
FROM recursive_chunks""",
    "chunk_ids": f"WITH {inputs.CHUNKS_SQL} SELECT document_id, chunk_index, chunk_id FROM chunks",
    "document_ids": "SELECT url, substr(sha256(url), 1, 16) AS document_id FROM pages",
    "chunk_metadata": """
SELECT doc_id, CAST(3 AS INTEGER) AS n_keys, source || '/' || doc_id AS source_path,
       CASE WHEN lang = 'en' THEN source ELSE 'transcription' END AS doc_type, lang
FROM documents""",
    "chunk_offsets": f"""
WITH RECURSIVE {_SENTENCE_SQL}
SELECT substr(text, start_char + 1, length(content)) = content AS at_offset, count(*) AS n_chunks
FROM sentence_chunks JOIN docs USING (document_id) GROUP BY 1""",
    "ingest_stats": f"""
WITH {inputs.CHUNKS_SQL}
SELECT CASE WHEN d = 0 THEN 'no_new_data' ELSE 'success' END AS status,
       d AS documents_processed, c AS chunks_created
FROM (SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS d,
             (SELECT count(*) FROM chunks WHERE CAST(document_id AS BIGINT) NOT IN (SELECT doc_id FROM labels)) AS c)""",
}
