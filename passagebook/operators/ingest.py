"""From transcriptions to chunk rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebook.functions.text import document_id, metadata_json, overlay, parse_metadata
from passagebook.operators.chunking import chunk
from passagebook.schemas import DOCUMENT_CHUNKS, conform
from passagebook.settings import Settings
from passagebook.sources.tables import Counted


def new_documents(
    transcriptions: DataFrame,
    ledger: DataFrame,
    key: str = "transcription_id",
    ledger_key: str = "document_id",
) -> DataFrame:
    """Transcriptions whose id is not in the ledger of processed documents.

    The ledger, not the chunk table, says what was processed, so a document without
    chunks is not picked again. No distinct: an anti join does not care about copies.
    """
    done = ledger.select(F.col(ledger_key).alias("_done"))
    return transcriptions.join(done, F.col(key) == F.col("_done"), "left_anti")


def with_path_id(documents: DataFrame, path: str = "audio_file_path") -> DataFrame:
    return documents.withColumn("document_id", document_id(F.col(path)))


def chunk_metadata(source_path: Column, doc_type: Column, own: Column) -> Column:
    """Path and type of the document, overridden by the document's own metadata."""
    base = F.create_map(F.lit("source_path"), source_path, F.lit("doc_type"), doc_type)
    return overlay(base, own)


def ingest(
    transcriptions: DataFrame,
    created_at: Column,
    settings: Settings | None = None,
    doc_type: str = "transcription",
) -> DataFrame:
    """Chunk rows in the declared schema, with no vectors yet."""
    s = settings or Settings()
    docs = transcriptions.select(
        F.col("transcription_id").alias("document_id"),
        F.col("text"),
        metadata_json(
            chunk_metadata(
                F.col("audio_file_path"), F.lit(doc_type), parse_metadata(F.col("metadata"))
            )
        ).alias("metadata"),
    )
    chunks = chunk(
        docs,
        strategy=s.chunking_strategy,
        size=s.chunk_size,
        overlap=s.chunk_overlap,
    )
    return conform(chunks.withColumn("created_at", created_at), DOCUMENT_CHUNKS)


def ingest_counted(
    new_docs: DataFrame,
    created_at: Column,
    write: Callable[[DataFrame], None],
    settings: Settings | None = None,
    doc_type: str = "transcription",
) -> dict:
    """Ingest and hand the chunk rows to `write`, which writes them once; status, documents
    processed and chunks created are counted as they pass."""
    seen, made = Counted(n=F.count(F.lit(1))), Counted(n=F.count(F.lit(1)))
    write(made.of(ingest(seen.of(new_docs), created_at, settings, doc_type)))
    documents = seen.get()["n"]
    return {
        "status": "success" if documents else "no_new_data", "documents_processed": documents, "chunks_created": made.get()["n"],
    }
