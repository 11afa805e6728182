"""Vectors for chunks: what is pending, the batched model call, and the merge back."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagebook.functions.models import Embedder, split_words, with_retry
from passagebook.functions.text import token_count
from passagebook.functions.vectors import has_vector, list_column
from passagebook.schemas import CHUNK_EMBEDDINGS, conform


# Rows of an Arrow batch whose texts and vectors a task holds at once.
SLICE_ROWS = 512


def in_slices(batches: Iterator[pa.RecordBatch], batch_size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole model calls, so that a call sees the same texts."""
    rows = max(1, SLICE_ROWS // batch_size) * batch_size
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pending(chunks: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Chunks without a vector: none in the row, and none in the embeddings table."""
    todo = chunks.filter(~F.coalesce(has_vector(F.col("embedding")), F.lit(False)))
    if embeddings is None:
        return todo
    done = embeddings.filter(has_vector(F.col("embedding"))).select("chunk_id")
    return todo.join(done, "chunk_id", "left_anti")


def embed(
    df: DataFrame,
    embedder: Embedder,
    text: str = "content",
    batch_size: int = 32,
    max_retries: int = 3,
    retry_delay: float = 1.0,
    spread: int | bool = True,
    by: str = "chunk_id",
    keep_text: bool = False,
) -> DataFrame:
    """All columns but the text, then embedding, token_count, attempts and error.

    The model sees `batch_size` texts per call. A batch that keeps failing, or comes back
    with the wrong number or length of vectors, gives rows with `error` set and no vector.

    Rows are first spread by the key `by`: a model call costs far more than moving its
    text, and the chunks of one long document would otherwise stay in one task. The number
    of partitions is the adaptive one, or `spread` if that is a number; spread=False leaves
    the rows where they are. With `keep_text` the text stays a column.
    """
    others = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType(
        [df.schema[c] for c in others]
        + [
            T.StructField("embedding", T.ArrayType(T.FloatType())),
            T.StructField("token_count", T.IntegerType()),
            T.StructField("attempts", T.IntegerType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def call(texts):
        vectors = np.asarray(embedder.embed(texts), dtype=np.float64)
        if vectors.shape != (len(texts), embedder.dim):
            raise ValueError(f"expected {len(texts)} vectors of {embedder.dim}, got shape {vectors.shape}")
        return vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, batch_size):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            vectors = np.zeros((len(texts), embedder.dim))
            errors: list[str | None] = []
            attempts: list[int] = []
            for i in range(0, len(texts), batch_size):
                part = texts[i : i + batch_size]
                got, tries, error = with_retry(
                    lambda part=part: call(part), max_retries, retry_delay, time.sleep
                )
                if error is None:
                    vectors[i : i + len(part)] = got
                errors += [error] * len(part)
                attempts += [tries] * len(part)
            listed = list_column(vectors)
            if any(errors):
                failed = pa.array([e is not None for e in errors])
                listed = pc.if_else(failed, pa.scalar(None, listed.type), listed)
            counts = [len(split_words(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in others),
                    listed,
                    pa.array(counts, type=pa.int32()),
                    pa.array(attempts, type=pa.int32()),
                    pa.array(errors, type=pa.string()),
                ],
                names=[*others, "embedding", "token_count", "attempts", "error"],
            )

    if spread is False:
        source = df
    else:
        source = df.repartition(by) if spread is True else df.repartition(spread, by)
    wanted = others if keep_text else [*others, text]
    return source.select(*wanted).mapInArrow(run, schema)


def embed_chunks(
    chunks: DataFrame, embedder: Embedder, created_at: Column, batch_size: int = 32, **options
) -> DataFrame:
    """Rows for the embeddings table: one per chunk, failed ones with their error."""
    rows = embed(chunks.select("chunk_id", "content"), embedder, batch_size=batch_size, **options)
    return conform(
        rows.withColumn("model", F.lit(embedder.name)).withColumn("created_at", created_at),
        CHUNK_EMBEDDINGS,
    )


def merge_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks with the new vector where there is one, the old one otherwise."""
    vector = F.col("embedding").cast("array<float>")
    new = embeddings.filter(has_vector(F.col("embedding")))
    if "created_at" in embeddings.columns:
        # A chunk embedded twice keeps its latest vector.
        new = new.groupBy("chunk_id").agg(
            F.max_by(vector, F.struct("created_at", vector)).alias("_new")
        )
    else:
        new = new.select("chunk_id", vector.alias("_new"))
    return (
        chunks.join(new, "chunk_id", "left")
        .withColumn("embedding", F.coalesce("_new", F.col("embedding").cast("array<float>")))
        .drop("_new")
        .select(*chunks.columns)
    )


def with_token_count(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("token_count", token_count(F.col(text)))


def dimension_check(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows with n_dims and whether it is the declared dimension; null vectors are not."""
    n = F.when(F.col(vector).isNull(), 0).otherwise(F.size(vector))
    return df.withColumn("n_dims", n).withColumn("dim_ok", F.col("n_dims") == dim)


def dimension_rejects(df: DataFrame, dim: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """Rows to set aside, whose vector has another number of values than declared: the key,
    n_dims and expected. A row without a vector is pending, not rejected."""
    checked = dimension_check(df.filter(has_vector(F.col(vector))), dim, vector)
    return checked.filter(~F.col("dim_ok")).select(key, "n_dims", F.lit(dim).alias("expected"))
