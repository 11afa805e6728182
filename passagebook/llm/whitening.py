"""Whitening of embeddings by exact, bit-sliced scatter.

Components become integers, floor(scale * c). In each batch every dimension is shifted by its
least value, and its bit planes are packed across the rows, 64 rows a word. The sum over rows
of the product of two dimensions is the sum over pairs of their planes of the number of rows in
which both bits are set, times the planes' weights; the shift is then taken out again in
integers. So sums and cross-products of all rows are exact, whatever their order, and the
covariance n * sum(x_d * x_e) - S_d * S_e is centred in integers too: only the finished matrix
becomes doubles, for eigh. A constant added to all entries changes nothing of it.

The scatter of a task is one row for each pair of dimensions, added up as partial aggregates;
what reaches the driver is a matrix of dimensions by dimensions. Vectors are read twice more,
where they lie: once to measure the covariance of the result, once for the result.

Defined results: vectors that are null or hold a null or non-finite entry take no part.
Vectors of each length are a fit list of their own (lengths are taken to be few); those without
entries have no component, hence no rows. Rows without an id, and repeated rows, each
count and each come back. A component whose eigenvalue is zero up to rounding cannot be
scaled: its whitened values are null, and it takes no part in identity_error, which is null
where no component is left; so is explained where nothing varies at all. An empty table gives
no rows. Integers of 2**50 or more in amount are an error. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.llm import bitplanes

MOST = 1 << 50
#: Rows that are packed together.
STRIP = 16384
_SUM = pa.decimal128(38, 0)


@dataclass
class Fit:
    """What the vectors of one length have in common; sums are those of floor(scale * c)."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, one a column
    trace: float
    scale: int
    varying: np.ndarray = field(init=False)

    def __post_init__(self):
        least = len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0), 0)
        self.varying = self.values > least

    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace > 0 else None for e in self.values]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def deviations(self, centred: np.ndarray) -> list[int]:
        """The sum of the squares of each row, exact."""
        most = int(np.abs(centred).max(initial=0))
        kind = np.int64 if most * most * max(1, centred.shape[1]) < 1 << 63 else object
        return [int(v) for v in (centred.astype(kind) ** 2).sum(axis=1)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections on all components over the root of their variance; nan where it is none."""
        root = np.sqrt(np.where(self.varying, self.values, np.nan))
        return (centred.astype(np.float64) / self.n) @ self.vectors / root


def _named(vectors: DataFrame, ident: str, vector: str) -> DataFrame:
    return vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("v"))


def scatter(vectors: DataFrame, scale: int = 64, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dim, d, e, total): for each length of vectors the exact sums of x_d * x_e for d <= e,
    and under d = -1 those of x_e, with the number of rows under e = -1."""

    def run(batches):
        count, sums, cross = {}, {}, {}
        for batch in batches:
            for dim, rows, x in bitplanes.sound_integers(batch.column(0), scale, MOST):
                if dim == 0:
                    continue
                for s in range(0, len(x), STRIP):
                    part = x[s : s + STRIP]
                    low = part.min(axis=0)
                    y = part - low
                    plain = y.sum(axis=0).astype(object)
                    low, n = low.astype(object), len(part)
                    # sum (y + l)(y + l)' = sum y y' + l (sum y)' + (sum y) l' + n l l'
                    full = bitplanes.cross_products(y) + np.outer(low, plain) + np.outer(plain, low) + n * np.outer(low, low)
                    count[dim] = count.get(dim, 0) + n
                    sums[dim] = sums.get(dim, 0) + plain + n * low
                    cross[dim] = cross.get(dim, 0) + full
        for dim in count:
            d, e = np.triu_indices(dim)
            total = [count[dim], *sums[dim].tolist(), *cross[dim][d, e].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(total), dim, np.int32)), pa.array(np.r_[np.full(dim + 1, -1), d].astype(np.int32)),
                    pa.array(np.r_[np.arange(-1, dim), e].astype(np.int32)), pa.array([Decimal(t) for t in total], _SUM),
                ],
                ["dim", "d", "e", "total"],
            )

    parts = _named(vectors, ident, vector).select("v").mapInArrow(run, "dim int, d int, e int, total decimal(38,0)")
    return parts.groupBy("dim", "d", "e").agg(F.sum("total").alias("total"))


def covariance(n: int, sums: list[int], cross: np.ndarray) -> np.ndarray:
    """The covariance with divisor n: centred in integers, then rounded once."""
    s = np.array(sums, dtype=object)
    centred = n * cross - np.outer(s, s)
    return np.array([[float(int(v)) for v in row] for row in centred]).reshape(len(s), len(s)) / float(n) / float(n)


def fit(vectors: DataFrame, scale: int = 64, ident: str = "vec_id", vector: str = "embedding") -> dict[int, Fit]:
    """A fit for each length of vectors."""
    found: dict[int, dict] = {}
    for row in scatter(vectors, scale, ident, vector).toLocalIterator():  # dim * dim / 2 rows a length
        found.setdefault(row.dim, {})[row.d, row.e] = int(row.total)
    fits = {}
    for dim, total in found.items():
        cross = np.array([[total[min(d, e), max(d, e)] for e in range(dim)] for d in range(dim)], dtype=object).reshape(dim, dim)
        n, sums = total[-1, -1], [total[-1, e] for e in range(dim)]
        v = covariance(n, sums, cross)
        values, axes = np.linalg.eigh(v)
        fits[dim] = Fit(n, sums, values[::-1].copy(), axes[:, ::-1].copy(), float(np.trace(v)), scale)
    return fits


def _errors(sent, components: int):
    """Over vectors: (dim, i, j, total), the sums of whitened values and of their products."""

    def run(batches):
        fits, first, second = sent.value, {}, {}
        for batch in batches:
            for dim, _, x in _fitted(batch.column(0), fits):
                w = fits[dim].whitened(fits[dim].centred(x))[:, :components]
                w = w[:, fits[dim].varying[:components]]
                first[dim] = first.get(dim, 0) + w.sum(axis=0)
                second[dim] = second.get(dim, 0) + w.T @ w
        for dim, total in first.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(total) + len(i), dim, np.int32)), pa.array(np.r_[np.full(len(total), -1), i].astype(np.int32)),
                    pa.array(np.r_[np.arange(len(total)), j].astype(np.int32)), pa.array(np.r_[total, second[dim][i, j]]),
                ],
                ["dim", "i", "j", "total"],
            )

    return run


def _fitted(column: pa.Array, fits: dict[int, Fit]):
    scale = next(iter(fits.values())).scale
    for dim, rows, x in bitplanes.sound_integers(column, scale, MOST):
        if dim:
            yield dim, rows, x


def identity_errors(vectors: DataFrame, fits: dict[int, Fit], components: int = 32, ident: str = "vec_id", vector: str = "embedding") -> dict[int, float | None]:
    """For each length the largest entry, in amount, of the covariance of the whitened values
    less the identity. The values are centred before they are multiplied; what is left
    of their mean by rounding is taken off as well."""
    if not fits:
        return {}
    parts = _named(vectors, ident, vector).select("v").mapInArrow(_errors(vectors.sparkSession.sparkContext.broadcast(fits), components), "dim int, i int, j int, total double")
    found: dict[int, dict] = {}
    for row in parts.groupBy("dim", "i", "j").agg(F.sum("total").alias("total")).toLocalIterator():
        found.setdefault(row.dim, {})[row.i, row.j] = row.total / fits[row.dim].n
    return {
        dim: max((abs(m - total[-1, i] * total[-1, j] - (i == j)) for (i, j), m in total.items() if i >= 0), default=None)
        for dim, total in found.items()
    }


def whiten(vectors: DataFrame, fits: dict[int, Fit], components: int = 32, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, deviation, whitened) of every sound vector: the exact sum of (n * x - S)^2
    as decimal(38,0), and its values on the first components, null where nothing varies."""

    sent = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        fits = sent.value
        for batch in batches:
            for dim, rows, x in _fitted(batch.column(1), fits):
                centred = fits[dim].centred(x)
                w = fits[dim].whitened(centred)[:, :components]
                values = pa.array(w.ravel(), from_pandas=True)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)), pa.array(np.full(len(x), dim, np.int32)),
                        pa.array([Decimal(v) for v in fits[dim].deviations(centred)], _SUM), pa.ListArray.from_arrays(offsets, values),
                    ],
                    ["vec_id", "dim", "deviation", "whitened"],
                )

    schema = "vec_id long, dim int, deviation decimal(38,0), whitened array<double>"
    if not fits:
        return vectors.sparkSession.createDataFrame([], schema)
    return _named(vectors, ident, vector).mapInArrow(run, schema)


def by_component(vectors: DataFrame, components: int = 32, scale: int = 64, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each sound vector and component, numbered from 1 by falling eigenvalue:
    (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    fits = fit(vectors, scale, ident, vector)
    errors = identity_errors(vectors, fits, components, ident, vector)
    about = vectors.sparkSession.createDataFrame(
        [(dim, i + 1, f.n, share, errors.get(dim)) for dim, f in fits.items() for i, share in enumerate(f.explained()[:components])],
        "dim int, component int, n long, explained double, identity_error double",
    )
    rows = whiten(vectors, fits, components, ident, vector).select("vec_id", "dim", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    # One row for each component of a length.
    return rows.withColumn("component", F.col("at") + 1).join(F.broadcast(about), ["dim", "component"]).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )
