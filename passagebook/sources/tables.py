"""Typed parquet tables: create, scan, append, replace, statistics, layout."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagebook.schemas import (
    CHUNK_EMBEDDINGS,
    DOCUMENT_CHUNKS,
    RAG_RESPONSES,
    TASK_LOGS,
    TRANSCRIPTIONS,
    TableSchema,
    conform,
)
from passagebook.sources.session import materialize

# Bits taken from each column of a z-order value, and salts within one value.
_BITS = 8
_SALTS = 64


def full_name(name: str, schema: str | None = None, catalog: str | None = None) -> str:
    """A name with a dot stays; others get catalog and schema in front."""
    if "." in name:
        return name
    return ".".join(p for p in (catalog, schema, name) if p)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_table(
    spark: SparkSession,
    name: str,
    schema: TableSchema,
    comment: str | None = None,
    properties: Mapping[str, str] | None = None,
    location: str | None = None,
) -> str:
    """Create the table unless it is there: 'created' or 'exists'."""
    if table_exists(spark, name):
        return "exists"
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
        for f in schema.struct().fields
    )
    parts = [f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"]
    if schema.partition_columns:
        parts.append(f"PARTITIONED BY ({', '.join(f'`{c}`' for c in schema.partition_columns)})")
    if location:
        parts.append(f"LOCATION {_quoted(location)}")
    if comment:
        parts.append(f"COMMENT {_quoted(comment)}")
    if properties:
        pairs = ", ".join(f"{_quoted(k)}={_quoted(v)}" for k, v in properties.items())
        parts.append(f"TBLPROPERTIES ({pairs})")
    spark.sql(" ".join(parts))
    return "created"


# The tables of a run and what they hold.
RUN_TABLES = {
    "transcriptions": (TRANSCRIPTIONS, "Transcribed text, one row per recording"),
    "document_chunks": (DOCUMENT_CHUNKS, "Chunks of documents"),
    "chunk_embeddings": (CHUNK_EMBEDDINGS, "Vectors of chunks"),
    "rag_responses": (RAG_RESPONSES, "Answers to queries"),
    "task_logs": (TASK_LOGS, "Runs of tasks"),
}


def setup_all_tables(spark: SparkSession, schema: str | None = None) -> dict[str, str]:
    return {
        name: create_table(spark, full_name(name, schema), declared, comment)
        for name, (declared, comment) in RUN_TABLES.items()
    }


def drop_table(spark: SparkSession, name: str) -> str:
    if not table_exists(spark, name):
        return "not_found"
    spark.sql(f"DROP TABLE {name}")
    return "dropped"


def read_table(spark: SparkSession, name: str) -> DataFrame | None:
    """The table, or None when it does not exist. Other failures are raised."""
    return spark.table(name) if table_exists(spark, name) else None


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write a table whose files hold one bucket of the key each, sorted by it. Joins and
    groupings by the key then read it where it lies, without a shuffle."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


class Counted:
    """Counts taken of rows as they are written, so that nothing is read for them again.

        counted = Counted(n=F.count(F.lit(1)))
        counted.of(df).write.parquet(path)
        counted.get()["n"]

    A count of a plan that turned out empty before it ran is 0.
    """

    def __init__(self, **counts: Column):
        self.counts, self.seen = counts, Observation(f"counted-{uuid.uuid4().hex[:8]}")

    def of(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in self.counts.items()])

    def get(self) -> dict[str, int]:
        found = self.seen.get
        return {n: int(found.get(n) or 0) for n in self.counts}


def append(df: DataFrame, name: str, schema: TableSchema) -> None:
    """Append rows in the declared schema."""
    conform(df, schema).write.mode("append").format("parquet").partitionBy(
        *schema.partition_columns
    ).saveAsTable(name)


def replace(df: DataFrame, name: str) -> None:
    """Replace the rows of a table by `df`, which may read that table.

    The rows are first written to the shared folder, so the table is not read while it is
    overwritten and a failed run can be repeated from there.
    """
    names = df.sparkSession.table(name).columns
    materialize(df.select(*names), "replace").write.mode("overwrite").insertInto(name)


def table_stats(df: DataFrame) -> DataFrame:
    """One row for a table of files: rows, files, bytes, first and last change.

    Files are listed, so those without rows count; rows are counted by file without reading
    any column.
    """
    spark = df.sparkSession
    files = [unquote(f) for f in df.inputFiles()]
    listed = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    if files:
        listed = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    rows = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    # Both are file names, written with more or fewer slashes behind the scheme.
    name = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/")
    files = listed.withColumn("path", name).join(rows.withColumn("path", name), "path", "left")
    return files.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count(F.lit(1)).alias("num_files"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.min("modificationTime").alias("created_at"),
        F.max("modificationTime").alias("last_modified"),
    )


def _number(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        # First six bytes: order enough to lay out files.
        head = F.rpad(F.substring(F.hex(F.col(name)), 1, 12), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_seconds(F.col(name).cast("timestamp")).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double")


def zorder(df: DataFrame, columns: Sequence[str], target: str, rows_per_file: int = 2_000_000) -> None:
    """Write the rows so that files cover small ranges of all the columns.

    Each column is scaled to 256 steps of its range (fewer where more than seven columns share
    the bits of a long) and the bits are interleaved; one range shuffle on that value lays out
    the files. Rows of one value are spread by a hash of
    the row, so a value with most of the rows fills several files.
    """
    if len(columns) > 63:
        raise ValueError("z-order takes at most 63 columns")
    numbers = {c: _number(df, c) for c in columns}
    ends = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(n).alias(f"lo_{c}") for c, n in numbers.items()],
        *[F.max(n).alias(f"hi_{c}") for c, n in numbers.items()],
    ).first()
    bits = []
    width = max(1, min(_BITS, 63 // max(1, len(columns))))
    for i, (c, n) in enumerate(numbers.items()):
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        top = (1 << width) - 1
        if lo is None or hi is None or hi <= lo:
            continue
        step = F.coalesce(F.floor((n - lo) / (hi - lo) * top), F.lit(0)).cast("int")
        for b in range(width):
            bit = F.shiftright(step, b).bitwiseAND(F.lit(1)).cast("bigint")
            bits.append(F.shiftleft(bit, b * len(columns) + i))
    z = reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint"))
    files = max(1, -(-ends["n"] // rows_per_file))
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(_SALTS))
    (
        df.withColumn("_z", z)
        .withColumn("_salt", salt)
        .repartitionByRange(files, "_z", "_salt")
        .sortWithinPartitions("_z")
        .drop("_z", "_salt")
        .write.parquet(target)
    )
