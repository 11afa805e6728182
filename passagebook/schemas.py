"""Declared table schemas and the cast that brings a DataFrame to one of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type names a table declaration may use.
TYPE_NAMES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


@dataclass(frozen=True)
class TableSchema:
    """Columns as (name, type name, nullable), with optional partition columns."""

    columns: tuple[tuple[str, str, bool], ...]
    partition_columns: tuple[str, ...] = ()

    def __post_init__(self):
        for name, type_name, _ in self.columns:
            if type_name.lower() not in TYPE_NAMES:
                raise ValueError(f"column {name}: unknown type {type_name!r}")
        missing = set(self.partition_columns) - set(self.names)
        if missing:
            raise ValueError(f"partition columns not in the table: {sorted(missing)}")

    @property
    def names(self) -> list[str]:
        return [name for name, _, _ in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(n, TYPE_NAMES[t.lower()], nullable) for n, t, nullable in self.columns]
        )


# The tables of a run.
DOCUMENT_CHUNKS = TableSchema(
    (
        ("chunk_id", "string", False),
        ("document_id", "string", False),
        ("content", "string", False),
        ("chunk_index", "integer", False),
        ("start_char", "integer", True),
        ("end_char", "integer", True),
        ("metadata", "string", True),
        ("embedding", "array<float>", True),
        ("created_at", "timestamp", False),
    )
)

TRANSCRIPTIONS = TableSchema(
    (
        ("transcription_id", "string", False),
        ("audio_file_path", "string", False),
        ("text", "string", False),
        ("duration_seconds", "float", True),
        ("language", "string", True),
        ("model", "string", True),
        ("metadata", "string", True),
        ("created_at", "timestamp", False),
    )
)

RAG_RESPONSES = TableSchema(
    (
        ("response_id", "string", False),
        ("query_id", "string", True),
        ("query_text", "string", False),
        ("response", "string", False),
        ("sources", "string", True),
        ("model", "string", True),
        ("tokens_used", "integer", True),
        ("retrieval_time_ms", "float", True),
        ("generation_time_ms", "float", True),
        ("created_at", "timestamp", False),
        ("status", "string", False),
    )
)

CHUNK_EMBEDDINGS = TableSchema(
    (
        ("chunk_id", "string", False),
        ("embedding", "array<float>", True),
        ("model", "string", False),
        ("token_count", "integer", True),
        ("created_at", "timestamp", False),
        ("error", "string", True),
    )
)

TASK_LOGS = TableSchema(
    (
        ("task_name", "string", False),
        ("run_timestamp", "timestamp", False),
        ("duration_seconds", "double", True),
        ("status", "string", False),
        ("records_processed", "bigint", True),
        ("records_failed", "bigint", True),
        ("metrics", "string", True),
        ("error_message", "string", True),
        ("logs", "string", True),
    )
)

AUDIO_METADATA = TableSchema(
    (
        ("path", "string", False),
        ("extension", "string", False),
        ("size_bytes", "bigint", False),
        ("modified_at", "timestamp", True),
    )
)


def conform(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Project and cast to the declared columns.

    A nullable column the input lacks becomes null. A required column it lacks is an
    error now; a null in a required column is an error on the executor that meets it.
    """
    present = set(df.columns)
    out = []
    for name, type_name, nullable in schema.columns:
        dtype = TYPE_NAMES[type_name.lower()]
        if name in present:
            value = F.col(f"`{name}`").cast(dtype)
        elif nullable:
            value = F.lit(None).cast(dtype)
        else:
            raise ValueError(f"required column {name} is missing")
        if not nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"null in {name}")).cast(dtype))
        out.append(value.alias(name))
    return df.select(*out)
