"""Incremental ingestion as a stream of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from passagebook.functions.models import Embedder
from passagebook.operators.embedding import embed_chunks
from passagebook.operators.indexing import SYNC_COLUMNS, build_index
from passagebook.operators.ingest import ingest
from passagebook.settings import Settings


def read_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_trigger: int = 100,
    pattern: str | None = None,
) -> DataFrame:
    """New parquet files of a folder as a stream, a bounded number per batch.

    `pattern` names entries of the folder: files, or folders whose files are the stream.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if not pattern:
        return reader.parquet(folder)
    # A plain name is spelled as a pattern too: as a path it would have to be a folder.
    plain = not any(c in pattern for c in "*?[{")
    return reader.parquet(f"{folder}/{pattern[:-1]}[{pattern[-1]}]" if plain else f"{folder}/{pattern}")


def ingest_stream(
    stream: DataFrame, target: str, checkpoint: str, created_at: Column, settings: Settings | None = None,
    embedder: Embedder | None = None, time: str | None = None, expire: str | None = None, every: str | None = None,
) -> StreamingQuery:
    """The incremental run: transcriptions as they are delivered, each ingested once."""
    fresh = first_deliveries(stream, "transcription_id", time, expire)
    return start(fresh, ingest_batches(target, created_at, settings, embedder), checkpoint, every)


def start(stream: DataFrame, write_batch, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run to the end of what is there, or for ever with a batch `every` so often."""
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    return writer.trigger(availableNow=True).start()


def write_rows(target: str):
    """Batch writer that repeats safely: a batch owns its folder and overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def first_deliveries(stream: DataFrame, key: str, time: str | None = None, expire: str | None = None) -> DataFrame:
    """The first delivery of each key, in whichever batch and after however many restarts.

    The keys seen are state of the query, kept by Spark's state store beside its checkpoint:
    a batch looks up the keys it brings and reads nothing that earlier batches wrote, so its
    cost does not grow with their number. With `time` and `expire` a key is forgotten that
    long after it was delivered, by the watermark of that column, and the state stays bounded.
    Rows without a key are all kept. Where one batch brings several rows of a key, one of
    them is kept; a batch that is repeated has the same keys, and overwrites what it wrote.
    For more keys than executors hold in memory set spark.sql.streaming.stateStore.providerClass
    to the RocksDB provider.
    """
    known = stream.filter(F.col(key).isNotNull())
    if expire is None:
        known = known.dropDuplicates([key])
    else:
        known = known.withWatermark(time, expire).dropDuplicatesWithinWatermark([key])
    return known.unionByName(stream.filter(F.col(key).isNull()))


def ingest_batches(
    target: str,
    created_at: Column,
    settings: Settings | None = None,
    embedder: Embedder | None = None,
):
    """Batch writer for transcriptions: chunks, and with an embedder vectors and index rows.

    Each stage reads what the stage before it wrote, so no stage runs twice; the batch
    itself is read once, as its deliveries may come from state. Deliveries that repeat are
    taken out of the stream before it, by `first_deliveries`.
    """
    s = settings or Settings()

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"batch={batch_id}"
        chunks_at, vectors_at, index_at = (f"{target}/{t}/{part}" for t in ("chunks", "vectors", "index"))
        ingest(batch, created_at, s).write.mode("overwrite").parquet(chunks_at)
        if embedder is None:
            return
        chunks = spark.read.parquet(chunks_at)
        embed_chunks(
            chunks, embedder, created_at, s.batch_size,
            max_retries=s.max_retries, retry_delay=s.retry_delay,
        ).write.mode("overwrite").parquet(vectors_at)
        vectors = spark.read.parquet(vectors_at).select("chunk_id", "embedding")
        build_index(
            chunks.drop("embedding").join(vectors, "chunk_id"), columns=SYNC_COLUMNS
        ).write.mode("overwrite").parquet(index_at)

    return write
