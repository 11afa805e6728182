"""The batch jobs on catalog tables: ingest, embed, index, answer, and all in order."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.functions.models import Embedder, Generator
from passagebook.operators.answers import answers_counted, batch_answers
from passagebook.operators.embedding import dimension_rejects, embed_chunks, merge_embeddings, pending
from passagebook.operators.indexing import (
    SYNC_COLUMNS,
    apply_sync,
    build_index,
    content_hash,
    index_status,
    source_stats,
)
from passagebook.operators.ingest import ingest_counted, new_documents
from passagebook.operators.metrics import run_record
from passagebook.schemas import CHUNK_EMBEDDINGS, DOCUMENT_CHUNKS, RAG_RESPONSES, TASK_LOGS, conform
from passagebook.settings import Settings
from passagebook.sources.session import materialize
from passagebook.sources.tables import Counted, append, read_table, replace, table_exists


class Tables:
    """Names of the tables of a run."""

    def __init__(self, schema: str | None = None):
        dot = f"{schema}." if schema else ""
        self.transcriptions = f"{dot}transcriptions"
        self.ledger = f"{dot}documents_done"
        self.chunks = f"{dot}document_chunks"
        self.vectors = f"{dot}chunk_embeddings"
        self.index = f"{dot}vector_index"
        self.rejects = f"{dot}vector_rejects"
        self.queries = f"{dot}queries"
        self.responses = f"{dot}rag_responses"
        self.logs = f"{dot}task_logs"


def _append_plain(df: DataFrame, name: str) -> None:
    df.write.mode("append").format("parquet").saveAsTable(name)


def ingest_job(spark: SparkSession, tables: Tables, settings: Settings, now: datetime) -> dict:
    source = read_table(spark, tables.transcriptions)
    if source is None:
        return {"status": "no_data", "documents_processed": 0, "chunks_created": 0}
    ledger = read_table(spark, tables.ledger)
    fresh = source if ledger is None else new_documents(source, ledger)
    # The ids of this run are fixed first: chunks, counts and ledger speak of the same rows.
    counted = Counted(n=F.count(F.lit(1)))
    ids = materialize(counted.of(fresh.select("transcription_id").distinct()), "new-documents")
    documents = counted.get()["n"]
    if not documents:
        return {"status": "no_new_data", "documents_processed": 0, "chunks_created": 0}
    fresh = source.join(ids, "transcription_id", "left_semi")
    # A run that stopped between the two appends left chunks without a ledger entry.
    written = read_table(spark, tables.chunks)
    if written is not None:
        seen = written.select(F.col("document_id").alias("transcription_id")).join(ids, "transcription_id", "left_semi")
        fresh = fresh.join(materialize(seen.distinct(), "written-documents"), "transcription_id", "left_anti")
    stats = ingest_counted(fresh, F.lit(now), lambda chunks: append(chunks, tables.chunks, DOCUMENT_CHUNKS), settings)
    _append_plain(ids.select(F.col("transcription_id").alias("document_id")), tables.ledger)
    return {**stats, "status": "success", "documents_processed": documents}


def embed_job(spark: SparkSession, tables: Tables, settings: Settings, embedder: Embedder, now: datetime) -> dict:
    chunks = read_table(spark, tables.chunks)
    if chunks is None:
        return {"status": "error", "message": f"no table {tables.chunks}", "chunks_embedded": 0}
    vectors = read_table(spark, tables.vectors)
    todo = pending(chunks)
    if vectors is not None:
        # Ids first: the content of chunks already embedded is not shuffled.
        ids = materialize(
            pending(chunks.select("chunk_id", "embedding"), vectors).select("chunk_id"), "pending"
        )
        todo = chunks.join(ids, "chunk_id", "left_semi")
    rows = embed_chunks(
        todo, embedder, F.lit(now), settings.batch_size,
        max_retries=settings.max_retries, retry_delay=settings.retry_delay,
    )
    counted = Counted(ok=F.count_if(F.col("error").isNull()), bad=F.count_if(F.col("error").isNotNull()))
    append(counted.of(rows), tables.vectors, CHUNK_EMBEDDINGS)
    counts = counted.get()
    if not any(counts.values()):
        return {"status": "no_new_chunks", "chunks_embedded": 0, "chunks_failed": 0}
    return {"status": "success", "chunks_embedded": counts["ok"], "chunks_failed": counts["bad"], "model": embedder.name}


def embedded_chunks(spark: SparkSession, tables: Tables) -> DataFrame:
    """The chunk table with its vectors."""
    chunks = spark.table(tables.chunks)
    vectors = read_table(spark, tables.vectors)
    return chunks if vectors is None else merge_embeddings(chunks, vectors)


def _index_rows(source: DataFrame, dim: int | None) -> DataFrame:
    return build_index(source, columns=SYNC_COLUMNS, dim=dim).withColumn(
        "content_hash", content_hash(["content", "metadata", "embedding"])
    )


def _set_aside(source: DataFrame, tables: Tables, dim: int | None) -> dict:
    """Write the rows whose vector has another length than `dim` to the table of rejects."""
    if dim is None:
        return {}
    counted = Counted(rejected=F.count(F.lit(1)))
    rejects = counted.of(dimension_rejects(source, dim))
    # The rejects are read from other tables than the one they replace.
    rejects.write.mode("overwrite").format("parquet").saveAsTable(tables.rejects)
    return counted.get()


def index_job(spark: SparkSession, tables: Tables, added_only: bool = False, dim: int | None = None) -> dict:
    """Bring the index up to the chunks.

    All rows are compared by key and hash: new, changed and deleted chunks are taken over.
    A caller who knows that chunks were only added may say so; then only those vectors are
    built and appended whose ids the index lacks. With `dim`, rows whose vector has another
    length are not indexed, and the table of rejects holds those the index lacks for it.
    """
    if not table_exists(spark, tables.chunks):
        return {"status": "error", "message": f"no table {tables.chunks}"}
    old = read_table(spark, tables.index)
    vectors = read_table(spark, tables.vectors)
    if old is not None and vectors is not None and added_only:
        done = vectors.filter(F.col("error").isNull()).select("chunk_id").distinct()
        ids = materialize(done.join(old.select("chunk_id"), "chunk_id", "left_anti"), "index-ids")
        fresh = merge_embeddings(
            spark.table(tables.chunks).join(ids, "chunk_id", "left_semi"),
            vectors.join(ids, "chunk_id", "left_semi"),
        )
        counted = Counted(added=F.count(F.lit(1)))
        _append_plain(counted.of(_index_rows(fresh, dim).select(*old.columns)), tables.index)
        return {"status": "success", **counted.get(), **_set_aside(fresh, tables, dim)}
    source = embedded_chunks(spark, tables)
    stats = source_stats(source).first().asDict()
    if stats["status"] != "success":
        return stats
    rows = _index_rows(source, dim)
    if old is None:
        # All there is was just written: nothing is missing, stale or left over.
        counted = Counted(covered=F.count(F.lit(1)))
        _append_plain(counted.of(rows), tables.index)
        status = {**counted.get(), "missing": 0, "stale": 0, "orphaned": 0, "ready": True}
    else:
        rows = materialize(rows, "index-rows")
        replace(apply_sync(old, rows), tables.index)
        status = index_status(spark.table(tables.index), rows).first().asDict()
    return {**stats, **status, **_set_aside(source, tables, dim)}


def answer_job(
    spark: SparkSession,
    tables: Tables,
    settings: Settings,
    embedder: Embedder,
    generator: Generator,
    now: datetime,
    run_id: str,
    **options,
) -> dict:
    responses = batch_answers(
        spark.table(tables.queries), spark.table(tables.index), embedder, generator,
        F.lit(now), run_id, settings, **options,
    )
    earlier = read_table(spark, tables.responses)
    if earlier is not None:  # a run that is repeated answers nothing twice
        responses = responses.join(earlier.select("response_id"), "response_id", "left_anti").select(*responses.columns)
    counted = answers_counted()
    append(counted.of(responses), tables.responses, RAG_RESPONSES)
    return {"status": "success", **counted.get()}


def logged(
    spark: SparkSession,
    tables: Tables,
    name: str,
    began: datetime,
    work: Callable[[], dict],
    clock: Callable[[], datetime] = datetime.now,
) -> dict:
    """Run a job and append its record to the task log; a failure is recorded and raised."""

    def record(status, result, message=None):
        counts = {k: v for k, v in result.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
        done = result.get("documents_processed", result.get("chunks_embedded", result.get("queries_processed", 0)))
        failed = result.get("chunks_failed", result.get("failed", 0))
        row = run_record(
            spark, name, began, (clock() - began).total_seconds(), status, done, failed, counts, message
        )
        append(conform(row, TASK_LOGS), tables.logs, TASK_LOGS)

    try:
        result = work()
    except Exception as exc:
        record("failed", {}, str(exc))
        raise
    record("success", result)
    return result


def full_batch(
    spark: SparkSession,
    tables: Tables,
    settings: Settings,
    embedder: Embedder,
    now: datetime,
) -> dict[str, dict]:
    """Ingest, embed and index in order, each stage logged."""
    stages = {
        "ingest": lambda: ingest_job(spark, tables, settings, now),
        "embed": lambda: embed_job(spark, tables, settings, embedder, now),
        "index": lambda: index_job(spark, tables, dim=embedder.dim),
    }
    return {name: logged(spark, tables, name, datetime.now(), work) for name, work in stages.items()}
