"""Document retrieval analytics on Spark tables.

Every operator takes DataFrames and returns DataFrames; Spark plans, partitions and
shuffles the work. Python runs on executors only, in Arrow batches, where text has to be
walked in order or a model function is called.
"""

from passagebook.schemas import (
    AUDIO_METADATA,
    CHUNK_EMBEDDINGS,
    DOCUMENT_CHUNKS,
    RAG_RESPONSES,
    TASK_LOGS,
    TRANSCRIPTIONS,
    TableSchema,
    conform,
)
from passagebook.settings import Settings
from passagebook.sources.session import local_session

__all__ = [
    "AUDIO_METADATA",
    "CHUNK_EMBEDDINGS",
    "DOCUMENT_CHUNKS",
    "RAG_RESPONSES",
    "Settings",
    "TASK_LOGS",
    "TRANSCRIPTIONS",
    "TableSchema",
    "conform",
    "local_session",
]
