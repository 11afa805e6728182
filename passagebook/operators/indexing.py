"""The vector index as a table: build, cells, difference to the source, status."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebook.functions.models import Embedder
from passagebook.functions.vectors import has_vector, unit
from passagebook.operators.embedding import embed

# The columns an index carries beside key and vector.
SYNC_COLUMNS = ("content", "metadata", "document_id", "chunk_index")


def source_stats(chunks: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: status, total and embedded chunks."""
    counts = chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.coalesce(has_vector(F.col(vector)), F.lit(False))).alias("embedded_chunks"),
    )
    status = (
        F.when(F.col("total_chunks") == 0, "no_data")
        .when(F.col("embedded_chunks") == 0, "no_embeddings")
        .otherwise("success")
    )
    return counts.select(status.alias("status"), "total_chunks", "embedded_chunks")


def content_hash(columns: Sequence[str]) -> Column:
    """Hash of the named columns; null and empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def build_index(
    chunks: DataFrame,
    key: str = "chunk_id",
    vector: str = "embedding",
    columns: Sequence[str] = SYNC_COLUMNS,
    dim: int | None = None,
) -> DataFrame:
    """Key, vector of length 1 and the synced columns, for rows that have a vector; with
    `dim`, for those whose vector has that many values."""
    fits = has_vector(F.col(vector))
    if dim is not None:
        fits = fits & (F.size(vector) == dim)
    return chunks.filter(fits).select(
        F.col(key).alias("chunk_id"), unit(F.col(vector)).alias("embedding"), *columns
    )


def build_index_from_text(
    chunks: DataFrame, embedder: Embedder, columns: Sequence[str] = SYNC_COLUMNS, **options
) -> DataFrame:
    """Index with the vectors computed from the content on the way."""
    carried = [c for c in columns if c != "content"]
    rows = embed(
        chunks.select("chunk_id", *carried, "content"), embedder, keep_text="content" in columns, **options
    )
    return build_index(rows, columns=columns)


def cell_count(rows: int, most: int = 4096) -> int:
    """Number of cells for an index: the root of its rows, so that cells and the rows of a
    cell grow alike; bounded, as centroids are sent to every task."""
    return max(1, min(most, math.isqrt(rows)))


# Rows that cells are learned from, and the most cells whose centroids start spread out: that
# start is made on the driver and costs the square of the cells. More start as rows of the sample.
SAMPLE_ROWS = 65_536
SPREAD_CELLS = 256


def train_cells(index: DataFrame, cells: int, seed: int = 42, sample: float | None = None) -> np.ndarray:
    """Centroids of `cells` k-means cells, as a (cells, dim) matrix.

    They are learned from a sample, by default of at most about SAMPLE_ROWS rows; every row is
    assigned to a cell afterwards.
    """
    rows = index.select("embedding")
    if sample is None:
        sample = min(1.0, SAMPLE_ROWS / max(1, index.count()))
    if sample < 1:
        rows = rows.sample(fraction=sample, seed=seed)
    start = "k-means||"
    if cells > SPREAD_CELLS:
        start, rows = "random", rows.distinct()  # copies would start as one cell
    rows = rows.select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=cells, seed=seed, featuresCol="features", maxIter=10, initMode=start).fit(rows)
    return np.asarray(model.clusterCenters())


def key_difference(index: DataFrame, source: DataFrame, key: str = "chunk_id", version: str = "content_hash") -> DataFrame:
    """Every key of both sides with its action: insert, update, delete or unchanged."""
    # One grouping of both sides: copies of a key shrink before the shuffle.
    nothing = F.lit(None).cast("string")
    old = index.select(F.col(key), F.col(version).alias("old"), nothing.alias("new"))
    new = source.select(F.col(key), nothing.alias("old"), F.col(version).alias("new"))
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "delete")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("update")
    )
    both = old.unionAll(new).groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return both.select(key, action.alias("action"))


def apply_sync(index: DataFrame, source: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Index brought up to the source: unchanged rows stay, changed and new ones come from
    the source, and rows the source no longer has are gone.

    Both sides carry `content_hash` and the same columns.
    """
    kept = index.join(source.select(key, "content_hash"), [key, "content_hash"], "left_semi")
    taken = source.join(index.select(key, "content_hash"), [key, "content_hash"], "left_anti")
    return kept.unionByName(taken).select(*index.columns)


def index_status(index: DataFrame, source: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: covered, missing, stale and orphaned keys, and whether the index is ready."""
    diff = key_difference(index, source, key)
    counts = diff.agg(
        F.count_if(F.col("action") == "unchanged").alias("covered"),
        F.count_if(F.col("action") == "insert").alias("missing"),
        F.count_if(F.col("action") == "update").alias("stale"),
        F.count_if(F.col("action") == "delete").alias("orphaned"),
    )
    ready = (F.col("missing") == 0) & (F.col("stale") == 0) & (F.col("orphaned") == 0)
    return counts.withColumn("ready", ready)
