"""Vector expressions, computed in numpy on Arrow batches, and the helpers that move
vectors in and out of numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_vector(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0)


def _elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements as float64, and the row each belongs to; null and empty rows have none."""
    counts = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, np.repeat(np.arange(len(column)), counts)


def _lengths(column: pa.Array) -> np.ndarray:
    flat, row = _elements(column)
    return np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(column)))


@F.arrow_udf(T.DoubleType())
def _norm(column: pa.Array) -> pa.Array:
    return pa.array(_lengths(column))


@F.arrow_udf(T.BooleanType())
def _bad(column: pa.Array) -> pa.Array:
    flat, row = _elements(column)
    return pa.array(np.bincount(row, weights=~np.isfinite(flat), minlength=len(column)) > 0)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _unit(column: pa.Array) -> pa.Array:
    flat, row = _elements(column)
    lengths = _lengths(column)
    flat = flat / np.where(lengths > 0, lengths, 1.0)[row]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))]).astype(np.int32)
    values = pa.array(flat.astype(np.float32))
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(column.is_null(), False)), values)


def norm(vector: Column) -> Column:
    """Euclidean length; 0 for a null or empty vector."""
    return _norm(vector.cast("array<float>"))


def has_bad_value(vector: Column) -> Column:
    """True when some element is NaN or infinite."""
    return _bad(vector.cast("array<float>"))


def unit(vector: Column) -> Column:
    """Vector scaled to length 1; a zero vector stays as it is."""
    return _unit(vector.cast("array<float>"))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Arrow list column as a float64 matrix. Rows must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    rows = len(column)
    if dim is None:
        dim = len(flat) // rows if rows else 0
    if len(flat) != rows * dim:
        raise ValueError(f"vectors differ in length; expected {dim} values in each")
    return flat.reshape(rows, dim).astype(np.float64)


def list_column(values: np.ndarray) -> pa.Array:
    """Float matrix as an Arrow list column."""
    rows, dim = values.shape
    offsets = np.arange(0, (rows + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(rows + 1, np.int32)
    flat = pa.array(values.astype(np.float32).reshape(-1), type=pa.float32())
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), flat)
