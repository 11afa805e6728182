"""Integers as bit planes: one bit of many integers in one 64-bit word.

The product sum of two rows of integers is a sum over pairs of their planes: the number of
bits that both planes set, times the weights of the two. Words are combined by AND and
counted, so nothing is ever rounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sound_integers(column: pa.Array, scale: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, x) for each length of vectors in a column of lists: the rows that are neither
    null nor hold a null or non-finite component, and floor(scale * component) of them.

    Integers of `most` or above, in amount, are an error: they would not be exact any more.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    stops = np.cumsum(np.maximum(lengths, 0))
    starts = stops - np.maximum(lengths, 0)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    sound = (lengths >= 0) & (bad[stops] == bad[starts])
    for dim in np.unique(lengths[sound]):
        rows = np.flatnonzero(sound & (lengths == dim))
        x = np.floor(scale * values[starts[rows][:, None] + np.arange(dim)[None, :]])
        if x.size and np.abs(x).max() >= most:
            raise ValueError(f"a component times {scale} is {most} or more in amount")
        yield int(dim), rows, x.astype(np.int64)


def weights(planes: int) -> list[int]:
    """Weights of the planes of two's complement: the last is that of the sign."""
    return [1 << p for p in range(planes - 1)] + [-(1 << (planes - 1))]


def row_planes(x: np.ndarray) -> np.ndarray:
    """(n, planes) words of n rows of 64 signed integers, as few planes as hold them all."""
    most = int(max(x.max(initial=0), -1 - x.min(initial=0)))
    count = most.bit_length() + 1
    out = np.empty((len(x), count), np.uint64)
    for p in range(count):
        bits = ((x >> p) & 1).astype(np.uint8)
        out[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def row_integers(planes: np.ndarray) -> np.ndarray:
    """The rows of 64 integers that row_planes packed."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little").reshape(len(planes), -1, 64)
    return np.einsum("npd,p->nd", bits, np.array(weights(planes.shape[1]), np.int64), dtype=np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(n, k): exact dot products of all rows of two sets of row planes."""
    out = np.zeros((len(left), len(right)), np.int64)
    for i, wi in enumerate(weights(left.shape[1])):
        for j, wj in enumerate(weights(right.shape[1])):
            out += np.bitwise_count(left[:, i, None] & right[None, :, j]).astype(np.int64) * (wi * wj)
    return out


def squares(planes: np.ndarray) -> np.ndarray:
    """The exact squared length of each row."""
    out = np.zeros(len(planes), np.int64)
    w = weights(planes.shape[1])
    for i in range(len(w)):
        for j in range(i, len(w)):
            both = np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
            out += both * (w[i] * w[j] * (1 if i == j else 2))
    return out


def column_planes(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Planes of each column of unsigned integers (n, dim), packed across the rows: words
    (planes, n / 64), and for each plane its column and bit. Columns have as many planes as
    their greatest value needs."""
    n = len(y)
    places = [(d, p) for d, top in enumerate(y.max(axis=0, initial=0)) for p in range(int(top).bit_length())]
    words = np.zeros((len(places), -(-n // 64)), np.uint64)
    for k, (d, p) in enumerate(places):
        packed = np.packbits(((y[:, d] >> p) & 1).astype(np.uint8), bitorder="little")
        words[k] = np.frombuffer(packed.tobytes().ljust(words.shape[1] * 8, b"\0"), "<u8")
    return words, places


def cross_products(y: np.ndarray) -> np.ndarray:
    """(dim, dim) exact sums of y_d * y_e over the rows of unsigned integers, as Python integers."""
    words, places = column_planes(y)
    counts = np.zeros((len(places), len(places)), np.int64)
    for k in range(len(places)):
        counts[k, k:] = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    # The sums fit 63 bits unless values are very large; then Python's integers hold them.
    fits = 2 * int(y.max(initial=0)).bit_length() + len(y).bit_length() < 63
    weight = np.zeros((len(places), y.shape[1]), np.int64 if fits else object)
    for k, (d, p) in enumerate(places):
        weight[k, d] = 1 << p
    return (weight.T @ counts.astype(weight.dtype) @ weight).astype(object)
