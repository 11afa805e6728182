"""Top-k search of many queries over the vector index.

Scores are dot products of unit vectors, rounded to `SCORE_DIGITS`, so that equal vectors
score the same whatever the layout. Ties go to the smaller chunk id. All ways give the
same rows:

* few queries (size checked): their matrix is broadcast, the index is scanned once where
  it lies, and each task sends back at most k rows per query;
* more queries: the index is cut into packs of bounded size, each of which is held by one
  group of the shuffle while the queries stream past it. Where there are few packs the queries
  are cut into blocks too, and an index row is sent once for each block.

Pairs are scored in 32 bits first; those that can reach the query's floor in spite of what that
may be off are scored again in 64 bits, and only this score counts. Vectors that are whole numbers
of some unit, as bags of words are, are screened for several queries with one product (see _Sieve).

Both move ids and vectors only. The columns of a result are fetched for the winners, by
chunk id, which is taken to be unique as in every index that upsert keeps.

Vectors with NaN or infinite values, or of another length than the queries, have no score and
are never found. Nothing is emitted per pair; a task keeps the best k rows per query while it
streams. The shuffled way and `sample` read the index twice, so it should be a stored table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagebook.functions.models import Embedder
from passagebook.functions.vectors import has_vector, matrix
from passagebook.operators.embedding import embed
from passagebook.sources.session import materialize

SCORE_DIGITS = 6

# Largest query side that is broadcast.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 << 20

# Index rows that a group of the shuffled way holds, and those of one file of a cell.
INDEX_SLICE = 50_000
INDEX_BLOCK = 500_000

# Groups of a search of all cells: packs of the index times blocks of the queries. From so many
# index rows on, a floor from this share of them bounds what is kept and sent back.
GROUPS = 64
FLOOR_ROWS, FLOOR_SHARE = 1 << 15, 1 / 16

# Index rows scored at once, so the score matrix stays small.
_STRIP = 1024

# Candidates gathered before they are cut to k per query.
_CANDIDATES = 2_000_000

# Packs that an exact search whose queries are too many to broadcast has at least.
EXACT_CELLS = 4

# What a score of 32 bits may be off, as a share of the product of both lengths and for each
# value of a vector, with room to spare; and half a unit of the last digit that counts.
_EPS32, _HALF = 2.0**-22, 10.0**-SCORE_DIGITS
# Lengths beyond which 32 bits do not do, pairs scored again at once, and the share of a strip
# from which it is scored whole.
_FAR, _PAIRS, _DENSE = 1e15, 8192, 0.05
# Pairs scored again in 32 bits at once.
_FEW = 1024

# Vectors of whole numbers: the largest number, what they may be off as a share of the length, what
# their least value is taken to stand for, and the values of 16 that share a place with another one.
_LARGEST, _OFF, _LEAST, _SHARED = 255, 1e-6, (1, 2, 3), 4
# Index rows that a sieve meets at once, and the bits of a product that are its own: all whole
# numbers below 2^53 are exact in 64 bits, and one bit is always set.
_NARROW, _BITS = 512, 52
# Units of the rows of one strip differ by less than this, as their largest stands for all.
_ALIKE = 1.2

# What a search finds before columns are fetched, and the rows of one batch of it.
_FOUND = "query_id string, score double, chunk_id string"
_FOUND_ROWS = 1 << 16

# Columns a search returns beside query_id, chunk_id, score and rank.
RESULT_COLUMNS = ("content", "document_id", "metadata", "chunk_index")


class _Best:
    """The best k index rows per query seen so far, by their ids."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.q = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.row = np.empty(0, np.int64)
        self.fresh = 0
        # A query with NaN or an infinite value has no nearest rows.
        self.floor = np.where(np.isfinite(queries).all(axis=1), floor, np.inf)
        self.pool = np.empty(0, object)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        return self.queries @ vectors.T

    def add(self, ids: np.ndarray, vectors: np.ndarray, sieve: _Sieve | None = None) -> None:
        if sieve is None:
            sound = np.isfinite(vectors).all(axis=1)
            if not sound.all():
                ids, vectors = ids[sound], vectors[sound]
        base = len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        if sieve is None:
            self.scan(vectors, base)
        else:
            self.sift(sieve, base)
        self._keep()
        used, self.row = np.unique(self.row, return_inverse=True)
        self.pool = self.pool[used]

    def scan(self, vectors: np.ndarray, base: int, only: np.ndarray | None = None) -> None:
        """Score finite vectors, which have places in the pool from `base` on, against all
        queries or those numbered."""
        for at in range(0, len(vectors), _STRIP):
            q, score, row = self._strip(vectors[at : at + _STRIP], only)
            self._take(q if only is None else only[q], score, row + at + base)
            if self.fresh > min(_CANDIDATES, 8 * self.k * len(self.queries)):
                self._keep()

    def _take(self, q: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        self.q = np.concatenate([self.q, q])
        self.score = np.concatenate([self.score, score])
        self.row = np.concatenate([self.row, row])
        self.fresh += len(q)

    def _strip(self, vectors: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, row) of the pairs of a strip that reach the floors; these rise where
        the strip shows that they can."""
        scores = np.round(self.scores(vectors), SCORE_DIGITS) + 0.0
        if scores.shape[1] > self.k:
            kth = np.partition(scores, -self.k, axis=1)[:, -self.k]
            np.maximum(self.floor, kth, out=self.floor)
        q, row = np.nonzero(scores >= self.floor[:, None])
        return q, scores[q, row], row

    def _keep(self) -> None:
        """Cut the candidates to k per query, by score and then chunk id."""
        alive = self.score >= self.floor[self.q]
        q, score, row = self.q[alive], self.score[alive], self.row[alive]
        used, inverse = np.unique(row, return_inverse=True)
        by_id = np.empty(len(used), np.int64)
        by_id[np.argsort(self.pool[used].astype(str), kind="stable")] = np.arange(len(used))
        order = np.lexsort((by_id[inverse], -score, q))
        q, score, row = q[order], score[order], row[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        top = place < self.k
        self.q, self.score, self.row, self.fresh = q[top], score[top], row[top], 0
        last = place[top] == self.k - 1
        np.maximum.at(self.floor, self.q[last], self.score[last])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.q), _FOUND_ROWS):
            part = slice(at, at + _FOUND_ROWS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.query_ids[self.q[part]].tolist(), pa.string()), pa.array(self.score[part]),
                    pa.array(self.pool[self.row[part]].tolist(), pa.string()),
                ],
                ["query_id", "score", "chunk_id"],
            )


class _Nearest(_Best):
    """The same for vectors, by products: screened in 32 bits, scored in 64."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        super().__init__(query_ids, queries, k, floor)
        # Those whose floor is infinite find nothing, whatever they hold.
        queries = self.queries = np.where(np.isposinf(self.floor)[:, None], 0.0, queries)
        self.lengths = np.sqrt((queries * queries).sum(axis=1))
        self.narrow = queries.astype(np.float32) if (self.lengths < _FAR).all() else None

    def _strip(self, vectors: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = slice(None) if only is None else only
        queries, floor = self.queries[some], self.floor[some]
        longest = float(np.sqrt(np.square(vectors, dtype=np.float64).sum(axis=1).max()))
        if self.narrow is None or longest >= _FAR:
            return self._whole(queries, vectors, some, floor)
        off = self.lengths[some] * longest * (vectors.shape[1] + 4) * _EPS32 + _HALF
        scores = self.narrow[some] @ vectors.astype(np.float32, copy=False).T
        low = np.flatnonzero(np.isneginf(floor))
        if len(low) and scores.shape[1] > self.k:
            floor[low] = np.partition(scores[low], -self.k, axis=1)[:, -self.k] - off[low]
        # Rounded down to 32 bits, the least score that may still do.
        hit = np.flatnonzero(scores >= np.nextafter((floor - off).astype(np.float32), np.float32(-np.inf))[:, None])
        if len(hit) > _DENSE * scores.size:
            return self._whole(queries, vectors, some, floor)
        q, row = np.divmod(hit, scores.shape[1])
        self.floor[some] = floor
        return self._reaching(queries, vectors, floor, q, row)

    def _reaching(self, queries, vectors, floor, q, row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs that reach the floors, with their scores."""
        exact = np.empty(len(q))
        for at in range(0, len(q), _PAIRS):
            part = slice(at, at + _PAIRS)
            exact[part] = np.einsum("nd,nd->n", queries[q[part]], vectors[row[part]].astype(np.float64))
        exact = np.round(exact, SCORE_DIGITS) + 0.0
        reach = exact >= floor[q]
        return q[reach], exact[reach], row[reach]

    def _whole(self, queries, vectors, some, floor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = np.round(queries @ vectors.astype(np.float64).T, SCORE_DIGITS) + 0.0
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
            self.floor[some] = floor
        q, row = np.nonzero(scores >= floor[:, None])
        return q, scores[q, row], row

    def _near(self, vectors: np.ndarray, longest: float, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Those of the pairs that can reach the floors, by their scores in 32 bits."""
        off = self.lengths * longest * (vectors.shape[1] + 4) * _EPS32 + _HALF
        least, near = np.nextafter((self.floor - off).astype(np.float32), np.float32(-np.inf)), []
        for at in range(0, len(q), _FEW):
            some, of = q[at : at + _FEW], row[at : at + _FEW]
            near.append(at + np.flatnonzero(np.einsum("nd,nd->n", self.narrow[some], vectors[of]) >= least[some]))
        return np.concatenate(near) if near else np.empty(0, np.int64)

    def sift(self, sieve: _Sieve, base: int) -> None:
        """As scan, of the rows of a sieve, with finite values. Queries and rows that are not whole
        numbers, and queries whose floor shuts nothing out, are scanned."""
        low = np.flatnonzero(np.isneginf(self.floor))
        if len(low):  # only for the floors: the pairs are found again
            self._strip(sieve.vectors[:_STRIP], low)
        counts = _Counts(self.queries)
        able = counts.fits & (self.floor > 0)
        rest = np.flatnonzero(~able & (self.floor < np.inf))
        if len(rest):
            self.scan(sieve.vectors, base, rest)
        able = np.flatnonzero(able & (self.floor < np.inf))
        for at in range(0, len(sieve.others) if len(able) else 0, _STRIP):
            rows = sieve.others[at : at + _STRIP]
            q, score, row = self._strip(sieve.vectors[rows], able)
            self._take(able[q], score, rows[row] + base)
        numbers = sieve.folded(counts.numbers[able], np.maximum)
        size = np.sqrt((numbers * numbers).sum(axis=1))
        order = np.argsort(size, kind="stable")
        for at in range(0, len(able), _STRIP):
            some = order[at : at + _STRIP]
            group = able[some]
            self._sift(sieve, base, group, numbers[some], size[some], counts.units[group], counts.off[group])

    def _sift(self, sieve: _Sieve, base: int, group, numbers, size, units, off) -> None:
        lengths, found, fresh, bits = self.lengths[group], [], 0, 0
        for at, end in sieve.strips:
            rows = sieve.rows[at:end]
            floor, width = self.floor[group], len(rows)
            # A score is units * unit * product, but for what both vectors are off; the first row has the largest unit.
            longest, far = sieve.lengths[at:end].max(), sieve.off[at:end].max()
            slack = off * longest + (lengths + off) * far + 1e-9 * lengths * longest + _HALF
            least = (floor - slack) / (units * sieve.units[at])
            least = np.maximum(np.ceil(least - 1e-6 * (1 + np.abs(least))), 0)
            most = np.floor(size * sieve.sizes[at:end].max() * (1 + 1e-9) + 1e-6)
            # A field holds half + product - least: it never overflows, and has its highest bit if the product does.
            wide = 1 + max(int((most - least).max()), 1).bit_length()
            while ((least > 2.0 ** (wide - 1)) & (most >= 2.0**wide)).any():
                wide += 1
            fields, half = _BITS // wide, 2.0 ** (wide - 1)
            vectors = None
            if fields > 1:
                if wide != bits:
                    bits, deep = wide, -(-len(group) // fields)
                    place = 2.0 ** (wide * np.arange(fields))
                    high = np.int64(sum(1 << (wide * f + wide - 1) for f in range(fields)))
                    held = np.zeros((deep * fields, numbers.shape[1] + 1))
                    held[: len(group), :-1] = numbers
                    packed = np.einsum("nfd,f->nd", held.reshape(deep, fields, -1), place)
                    products, marked = np.empty(deep * _NARROW), np.empty(deep * _NARROW, bool)
                start = np.zeros(deep * fields)
                start[: len(group)] = half - np.minimum(least, half)
                packed[:, -1] = start.reshape(deep, fields) @ place + 2.0**_BITS
                strip = np.ones((width, numbers.shape[1] + 1))
                strip[:, :-1] = sieve.numbers[at:end]
                product, mark = (x[: deep * width].reshape(deep, width) for x in (products, marked))
                np.matmul(packed, strip.T, out=product)
                held_bits = product.view(np.int64)
                np.bitwise_and(held_bits, high, out=held_bits)
                np.not_equal(held_bits, 0, out=mark)
                hit = np.flatnonzero(mark)
                if len(hit) <= _DENSE * len(group) * width:
                    value, (line, row) = held_bits.reshape(-1)[hit], np.divmod(hit, width)
                    which = [np.flatnonzero(value >> (wide * f + wide - 1) & 1) for f in range(fields)]
                    q = np.concatenate([line[w] * fields + f for f, w in enumerate(which)])
                    row = np.concatenate([row[w] for w in which])
                    vectors, q = sieve.vectors[rows], group[q]
                    if self.narrow is not None and longest < _FAR:
                        near = self._near(vectors.astype(np.float32, copy=False), longest, q, row)
                        q, row = q[near], row[near]
                    q, score, row = self._reaching(self.queries, vectors, self.floor, q, row)
                    row = rows[row]
            if vectors is None:
                vectors = sieve.vectors[rows]
                q, score, row = self._strip(vectors, group)
                q, row = group[q], rows[row]
            found.append((q, score, row + base))
            fresh += len(q)
            if fresh > min(_CANDIDATES, 2 * self.k * len(group)):
                self._take(*map(np.concatenate, zip(*found)))
                self._keep()
                found, fresh = [], 0
        if found:
            self._take(*map(np.concatenate, zip(*found)))


class _Counts:
    """Vectors as whole numbers of a unit each, for those that `fits` names: `off` is the length of
    what is left. Bags of words scaled to length 1 are such vectors."""

    def __init__(self, vectors: np.ndarray):
        self.numbers = np.zeros(vectors.shape, np.uint8)
        self.units, self.off, self.fits = np.ones(len(vectors)), np.zeros(len(vectors)), np.zeros(len(vectors), bool)
        with np.errstate(all="ignore"):
            for at in range(0, len(vectors), _STRIP):
                self._count(vectors[at : at + _STRIP].astype(np.float64), at)

    def _count(self, vectors: np.ndarray, at: int) -> None:
        least = np.where(vectors > 0, vectors, np.inf).min(axis=1)
        least[np.isposinf(least)] = 1.0
        left = np.flatnonzero((vectors >= 0).all(axis=1))
        for stands_for in _LEAST:
            some = vectors[left]
            numbers = np.rint(some * (stands_for / least[left])[:, None])
            squares = (numbers * numbers).sum(axis=1)
            units = np.where(squares > 0, (some * numbers).sum(axis=1) / np.maximum(squares, 1), 1.0)
            off = np.sqrt(((some - numbers * units[:, None]) ** 2).sum(axis=1))
            fit = (numbers.max(axis=1) <= _LARGEST) & (off <= _OFF * units * np.sqrt(squares)) & (units > 0)
            done = left[fit]
            self.numbers[at + done], self.units[at + done], self.off[at + done], self.fits[at + done] = numbers[fit], units[fit], off[fit], True
            left = left[~fit]
            if not len(left):
                break


class _Sieve:
    """Index rows, to be met by many queries, whose vectors are whole numbers of a unit each.

    Products of such vectors are small whole numbers, so several queries are put into the digits of
    one number and multiplied at once; every digit is exact. A digit starts from what its query's
    floor asks for, so that its highest bit alone says whether the floor can be reached. Values that
    are small in most rows share a place two by two: the sum of a row's, times the larger of a
    query's, is no less than their two products. What passes is scored again in 64 bits.
    """

    def __init__(self, vectors: np.ndarray):
        counts = _Counts(vectors)
        self.vectors, self.others = vectors, np.flatnonzero(~counts.fits)
        rows = np.flatnonzero(counts.fits)
        # Those of one strip have units close to each other.
        self.rows = rows[np.argsort(-counts.units[rows], kind="stable")]
        self.units, self.off, numbers = counts.units[self.rows], counts.off[self.rows], counts.numbers[self.rows]
        self.strips, at = [], 0
        while at < len(self.rows):
            end = min(at + _NARROW, int(np.searchsorted(-self.units, -self.units[at] / _ALIKE, "right")))
            self.strips.append((at, end))
            at = end
        dim = vectors.shape[1]
        strips = [slice(at, at + _STRIP) for at in range(0, len(numbers), _STRIP)]
        weight = sum((np.square(numbers[s], dtype=np.float64).sum(axis=0) for s in strips), np.zeros(dim))
        order, shared = np.argsort(-weight, kind="stable"), dim * _SHARED // 32
        self.places = order[: dim - 2 * shared], order[dim - 2 * shared : dim - shared], order[dim - shared :]
        self.numbers = np.concatenate([self.folded(numbers[s], np.add) for s in strips] or [np.zeros((0, dim - shared))]).astype(np.uint16)
        self.sizes = np.concatenate([np.sqrt(np.square(self.numbers[s], dtype=np.float64).sum(axis=1)) for s in strips] or [np.zeros(0)])
        self.lengths = np.concatenate([np.sqrt(np.square(vectors[self.rows[s]], dtype=np.float64).sum(axis=1)) for s in strips] or [np.zeros(0)])

    def folded(self, numbers: np.ndarray, both) -> np.ndarray:
        alone, first, second = self.places
        numbers = numbers.astype(np.float64)
        return np.concatenate([numbers[:, alone], both(numbers[:, first], numbers[:, second])], axis=1)

    @classmethod
    def of(cls, vectors: np.ndarray) -> _Sieve | None:
        """None if a part of the rows shows that most are not whole numbers."""
        some = vectors[:: max(1, len(vectors) // _STRIP)]
        return cls(vectors) if _Counts(some).fits.mean() > 0.5 else None


def _fitting(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """The rows whose vector is as long as the queries'."""
    fits = pc.equal(pc.list_value_length(batch.column("embedding")), dim)
    return batch.filter(fits)


def _ids(batch: pa.RecordBatch, name: str = "chunk_id") -> np.ndarray:
    return np.asarray(batch.column(name).to_pylist(), dtype=object)


def _final(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("chunk_id"))
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "score", "chunk_id")


def fetch(found: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Found rows with columns of the index. They are written first: their number is then
    known, and where it is small they are broadcast and the index stays where it lies."""
    columns = [c for c in columns if c != "chunk_id"]
    if not columns:
        return found
    found = materialize(found, "found")
    return found.join(index.select("chunk_id", *columns), "chunk_id").select(*found.columns, *columns)


def _search_broadcast(query_ids, queries, floor, index: DataFrame, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((query_ids, queries, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, least = shared.value
        best = _Nearest(ids, wanted, k, least)
        for batch in batches:
            batch = _fitting(batch, wanted.shape[1])
            if batch.num_rows:
                best.add(_ids(batch), matrix(batch.column("embedding"), wanted.shape[1]))
        yield from best.batches()

    return index.select("chunk_id", "embedding").mapInArrow(run, _FOUND)


def _in_slices(queries: DataFrame, index: DataFrame, payload: str, rows_per_slice: int) -> DataFrame:
    """Both sides by (cell, _slice): first the index rows (_side 0), then the queries that
    want their cell. A cell with many rows is cut into slices, so what a group holds is
    bounded however the rows spread over the cells; a query goes to all slices of its cells.
    Cells are a parameter of the index, so the counts per cell are a broadcast of known size.
    """
    slices = F.broadcast(index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows_per_slice).cast("int").alias("_slices")))
    kind = index.schema[payload].dataType
    asked = queries.join(slices, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), F.lit(1).alias("_side"),
        F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast(kind).alias(payload), "query_id", "floor", "query_vector",
    )
    rows = index.join(slices, "cell").select(
        "cell", F.pmod(F.xxhash64(F.lit(1), "chunk_id"), F.col("_slices")).cast("int").alias("_slice"), F.lit(0).alias("_side"),
        "chunk_id", payload, F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("double").alias("floor"),
        F.lit(None).cast(queries.schema["query_vector"].dataType).alias("query_vector"),
    )
    return rows.unionByName(asked).repartition("cell", "_slice").sortWithinPartitions("cell", "_slice", "_side")


def _meet(held, best, keys=("cell", "_slice", "_side"), whole: bool = False, strips: int = 1):
    """Over the rows of _in_slices: `held(parts)` makes what a group holds of its index rows,
    ids first, or None if there are none; `best(cell, held, query_ids, vectors, floors)`
    yields the rows found for a part of the queries, some strips of them, which with `whole` it
    gets too."""
    names, most = keys, strips * _STRIP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, kept = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                part = batch.slice(lo, hi - lo)
                if tuple(keys[lo, :2]) != current:
                    current, parts, kept = tuple(keys[lo, :2]), [], None
                if keys[lo, 2] == 0:
                    parts.append(part)
                    continue
                if parts:
                    kept, parts = held(parts), []
                if kept is not None:
                    vectors, ids, floors = matrix(part.column("query_vector")), _ids(part, "query_id"), part.column("floor").to_numpy()
                    for at in range(0, len(ids), most):
                        s = slice(at, at + most)
                        more = [part.slice(at, most)] if whole else []
                        yield from best(current[0], kept, ids[s], vectors[s], floors[s], *more)

    return run


def _held_vectors(parts):
    """The vectors of one length each, and their sieve: queries of another length find none of
    them, and no query one with NaN or infinite values."""
    by_length = {}
    for part in parts:
        lengths = pc.list_value_length(part.column("embedding")).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            some = part.filter(pa.array(lengths == dim))
            by_length.setdefault(int(dim), []).append((_ids(some), _own(some.column("embedding"), int(dim))))
    out = {}
    while by_length:
        dim, some = by_length.popitem()
        ids, vectors = (np.concatenate(x) for x in zip(*some))
        sound = np.isfinite(vectors).all(axis=1)
        if not sound.all():
            ids, vectors = ids[sound], vectors[sound]
        if len(ids):
            out[dim] = ids, vectors, _Sieve.of(vectors)
    return out


def _best_of(k: int):
    def best(cell, kept, ids, vectors, floors):
        if vectors.shape[1] in kept:
            found = _Nearest(ids, vectors, k, floors.copy())
            found.add(*kept[vectors.shape[1]])
            yield from found.batches()

    return best


def _search_grouped(queries: DataFrame, index: DataFrame, k: int, rows_per_slice: int | None = None) -> DataFrame:
    """Both sides carry `cell`; queries meet the index rows of their cells."""

    together = _in_slices(queries, index, "embedding", rows_per_slice or INDEX_SLICE)
    return together.mapInArrow(_meet(_held_vectors, _best_of(k)), _FOUND)


def _own(column: pa.Array, dim: int) -> np.ndarray:
    """matrix() without a change of type, so that values of 32 bits take no more room."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim) if flat.dtype in (np.float32, np.float64) else matrix(column, dim)


def _packs(queries: int, rows: int, least: int) -> tuple[int, int]:
    """How many packs of the index and blocks of the queries: packs of bounded size, GROUPS
    groups in all, and as few rows sent as that allows."""
    bounded = max(least, -(-rows // (2 * INDEX_SLICE)))
    packs = max(bounded, min(GROUPS, math.isqrt(GROUPS * max(1, rows) // max(1, queries))))
    return packs, max(1, -(-GROUPS // packs))


def _search_packed(queries: DataFrame, index: DataFrame, k: int, packs: int, blocks: int) -> DataFrame:
    """Every query meets every index row. A group holds a pack of the index, and a block of the
    queries streams past it."""
    kind = index.schema["embedding"].dataType
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(
        each(packs).alias("_pack"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block"), F.lit(1).alias("_side"),
        F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast(kind).alias("embedding"), "query_id", "floor", "query_vector",
    )
    rows = index.select(
        F.pmod(F.xxhash64(F.lit(1), "chunk_id"), F.lit(packs)).cast("int").alias("_pack"), each(blocks).alias("_block"), F.lit(0).alias("_side"),
        "chunk_id", "embedding", F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("double").alias("floor"),
        F.lit(None).cast(queries.schema["query_vector"].dataType).alias("query_vector"),
    )
    together = rows.unionByName(asked).repartition("_pack", "_block").sortWithinPartitions("_pack", "_block", "_side")
    return together.mapInArrow(_meet(_held_vectors, _best_of(k), ("_pack", "_block", "_side"), strips=4), _FOUND)


def _search_cells(queries: DataFrame, index: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """Queries meet the index rows of the cells they want. Whole cells are packed together, and
    those with many rows cut, so that a query goes once to a pack however many of its cells it
    wants; which they are goes with it, in a bit for each. The counts are one row a cell."""
    counts = first_rows(index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), len(centroids)).sort_by("cell")
    numbers, sizes = (counts.column(c).to_numpy().astype(np.int64) for c in ("cell", "n"))
    total = int(sizes.sum())
    packs, blocks = _packs(queries.count(), total, 1)
    room = max(1, min(2 * INDEX_SLICE, -(-total // packs)))
    first, parts, cells_of, filled = [], [], [], room
    for cell, n in zip(numbers.tolist(), sizes.tolist()):
        if n > room:  # a cell by itself, in several packs
            first.append(len(cells_of))
            parts.append(-(-n // room))
            cells_of += [[cell]] * parts[-1]
            filled = room
            continue
        if filled + n > room:
            cells_of.append([])
            filled = 0
        first.append(len(cells_of) - 1)
        parts.append(1)
        cells_of[-1].append(cell)
        filled += n
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast([np.array(c, np.int64) for c in cells_of])
    vector, kind = queries.schema["query_vector"].dataType, index.schema["embedding"].dataType
    places = F.broadcast(spark.createDataFrame(list(zip(numbers.tolist(), first, parts)), "cell int, _first int, _parts int"))
    rows = index.join(places, "cell").select(
        (F.col("_first") + F.pmod(F.xxhash64(F.lit(1), "chunk_id"), F.col("_parts"))).cast("int").alias("_pack"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(0).alias("_side"), F.col("cell").cast("int").alias("cell"),
        "chunk_id", "embedding", F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("double").alias("floor"),
        F.lit(None).cast(vector).alias("query_vector"), F.lit(None).cast("binary").alias("wanted"),
    )
    every = probes >= len(centroids)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, width = sent.value, len(centroids)
        for batch in _strips(batches, _STRIP):
            near = np.zeros((batch.num_rows, width), bool)
            for row, cells in enumerate([] if every else batch.column("cells").to_pylist()):
                near[row, cells] = True
            for pack, cells in enumerate(packed):
                bits = np.ones((batch.num_rows, len(cells)), bool) if every else near[:, cells]
                to = pa.array(np.flatnonzero(bits.any(axis=1)))
                masks = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(to), pack, np.int32)), *batch.select(["_block", "query_id", "floor", "query_vector"]).take(to).columns,
                        pa.array([masks[i].tobytes() for i in to.to_numpy()], pa.binary()),
                    ],
                    ["_pack", "_block", "query_id", "floor", "query_vector", "wanted"],
                )

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block")
    asked = queries.select(block, "query_id", "floor", "query_vector", *([] if every else ["cells"])).mapInArrow(
        send, f"_pack int, _block int, query_id string, floor double, query_vector {vector.simpleString()}, wanted binary"
    ).select(
        "_pack", "_block", F.lit(1).alias("_side"), F.lit(None).cast("int").alias("cell"), F.lit(None).cast("string").alias("chunk_id"),
        F.lit(None).cast(kind).alias("embedding"), "query_id", "floor", "query_vector", "wanted",
    )
    together = rows.unionByName(asked).repartition("_pack", "_block").sortWithinPartitions("_pack", "_block", "_side", "cell")

    def held(parts):
        ids, vectors = (np.concatenate(p) for p in zip(*[(_ids(p), _own(p.column("embedding"), centroids.shape[1])) for p in parts]))
        cells = np.concatenate([p.column("cell").to_numpy() for p in parts])
        sound = np.isfinite(vectors).all(axis=1)
        return (ids, vectors, cells) if sound.all() else (ids[sound], vectors[sound], cells[sound])

    def best(pack, kept, ids, vectors, floors, part):
        found = _Nearest(ids, vectors, k, floors.copy())
        found.pool, rows, cells = kept
        bits = np.frombuffer(b"".join(part.column("wanted").to_pylist()), np.uint8).reshape(len(ids), -1)
        bits = np.unpackbits(bits, axis=1, count=len(sent.value[pack])).astype(bool)
        if bits.all():
            found.scan(rows, 0)
        else:
            for place, cell in enumerate(sent.value[pack]):
                lo, hi = np.searchsorted(cells, [cell, cell + 1])
                only = np.flatnonzero(bits[:, place])
                if hi > lo and len(only):
                    found.scan(rows[lo:hi], lo, only)
        found._keep()
        yield from found.batches()

    return together.mapInArrow(_meet(held, best, ("_pack", "_block", "_side"), whole=True), _FOUND)


def _strips(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def first_rows(queries: DataFrame, limit: int) -> pa.Table:
    """All rows, or the first limit + 1 if there are more."""
    table = queries.limit(limit + 1).toArrow()
    return table


def _small(queries: DataFrame, limit: int, max_bytes: int):
    """Ids, matrix and floors of the queries if they are few, else None. Reads at most
    limit + 1 rows."""
    table = first_rows(queries, limit)
    if table.num_rows > limit or table.nbytes > max_bytes:
        return None
    ids = np.asarray(table.column("query_id").to_pylist(), dtype=object)
    return ids, matrix(table.column("query_vector")), table.column("floor").to_numpy()


def _with_floor(queries: DataFrame, floors: DataFrame | None, least: float | None = None) -> DataFrame:
    """Queries with the score below which no row can be among the best, or is wanted."""
    lowest = F.lit(float("-inf") if least is None else float(least))
    if floors is None:
        return queries.withColumn("floor", lowest)
    return queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))


def with_filters(index: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Index rows that pass: a list means any of its values, anything else equality."""
    for name, wanted in (filters or {}).items():
        if isinstance(wanted, (list, tuple, set, frozenset)):
            index = index.filter(F.col(name).isin(list(wanted)))
        elif wanted is None:
            index = index.filter(F.col(name).isNull())
        else:
            index = index.filter(F.col(name) == wanted)
    return index


def top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    filters: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
    sample: float | None = None,
    least: float | None = None,
) -> DataFrame:
    """The k index rows nearest to every query, after the filters.

    queries: query_id, query_vector. index: chunk_id, embedding and what it carries.
    Returns query_id, rank, score, chunk_id and `columns`.

    Every task sends back up to k rows per query. For many queries on an index of many
    files, `sample` bounds that: the k-th best score within a sample of the index can only
    be lower than the one within all of it, so rows below it are left out early. The
    result is the same; about k / sample rows per query are shuffled in all.

    With `least` rows that score less are left out, and need not be looked for.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    index = with_filters(index, filters)
    if columns is None:
        columns = [c for c in RESULT_COLUMNS if c in index.columns]
    index = index.filter(has_vector(F.col("embedding")))
    queries = queries.filter(has_vector(F.col("query_vector"))).select(
        F.col("query_id").cast("string").alias("query_id"), "query_vector"
    )
    floors = None
    if sample is not None:
        some = materialize(index.select("chunk_id", "embedding").sample(fraction=sample, seed=42), "sample")
        part = top_k(queries, some, k, None, [], broadcast_queries, least=least)
        floors = part.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        floors = materialize(floors, "floors")
    queries = _with_floor(queries, floors, least)
    small = _small(queries, broadcast_queries, BROADCAST_BYTES)
    if small is None:
        rows = index.count()
        if sample is None and rows > FLOOR_ROWS:
            return top_k(queries, index, k, None, columns, broadcast_queries, FLOOR_SHARE, least)
        packs, blocks = _packs(queries.count(), rows, EXACT_CELLS)
        found = _search_packed(queries, index, k, packs, blocks)
    elif len(small[0]):
        found = _search_broadcast(*small, index, k)
    else:
        found = index.sparkSession.createDataFrame([], _FOUND)
    return fetch(_final(found, k), index, columns)


def nearest_cells(centroids: np.ndarray, vector: Column, probes: int) -> Column:
    """Numbers of the `probes` centroids nearest to the vector, nearest first."""
    half_squares = (centroids * centroids).sum(axis=1) / 2

    @F.pandas_udf("array<int>")
    def pick(vectors):
        if not len(vectors):
            return vectors
        rows, near = vectors.to_numpy(), []
        for at in range(0, len(rows), _STRIP):
            scores = np.stack(rows[at : at + _STRIP]).astype(np.float64) @ centroids.T - half_squares
            if probes == 1:  # every row of an index comes this way: no sort
                near += list(scores.argmax(axis=1).astype(np.int32)[:, None])
            else:
                near += list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(near)

    return pick(vector)


def assign_cells(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows with the number of their nearest centroid; vectors of another length than these
    are left out."""
    rows = index.filter(has_vector(F.col("embedding")) & (F.size("embedding") == centroids.shape[1]))
    return rows.withColumn("cell", nearest_cells(centroids, F.col("embedding"), 1)[0])


def write_cells(celled: DataFrame, path: str, rows_per_file: int = INDEX_BLOCK) -> DataFrame:
    """Write the index partitioned by cell, so a search reads the cells it probes, and read
    it back. Rebalanced by cell, so that one that holds many rows is spread over several writers."""
    writer = celled.hint("rebalance", "cell").write.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("cell").parquet(path)
    return celled.sparkSession.read.schema(celled.schema).parquet(path)


def ask_cells(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(query_id, query_vector, place, cell): a row for each of the `probes` cells nearest to a
    query, nearest first, written to the shared folder."""
    fits = has_vector(F.col("query_vector")) & (F.size("query_vector") == centroids.shape[1])
    asked = queries.filter(fits).select(
        F.col("query_id").cast("string").alias("query_id"),
        "query_vector",
        F.posexplode(nearest_cells(centroids, F.col("query_vector"), probes)).alias("place", "cell"),
    )
    return materialize(asked, "asked")


def only_cells(index: DataFrame, asked: DataFrame, cells: int) -> DataFrame:
    """The index rows of the cells asked for, whose numbers name the folders to read."""
    probed = asked.select("cell").distinct().toArrow().column("cell").to_pylist()
    return index.filter(F.col("cell").isin(probed)) if len(probed) < cells else index


def top_k_cells(
    queries: DataFrame,
    index: DataFrame,
    centroids: np.ndarray,
    k: int = 10,
    probes: int = 4,
    filters: Mapping[str, object] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Approximate top-k: only the `probes` nearest cells of each query are searched.

    `index` carries `cell`. With all cells probed the rows equal `top_k`. The numbers of the
    probed cells, at most one per centroid, are fetched and name the folders to read.
    """
    index = with_filters(index, filters)
    if columns is None:
        columns = [c for c in RESULT_COLUMNS if c in index.columns]
    fits = has_vector(F.col("query_vector")) & (F.size("query_vector") == centroids.shape[1])
    asked = queries.filter(fits).select(F.col("query_id").cast("string").alias("query_id"), "query_vector")
    if probes < len(centroids):
        asked = asked.withColumn("cells", nearest_cells(centroids, F.col("query_vector"), probes))
    asked = materialize(asked, "asked")
    if probes < len(centroids):
        index = only_cells(index, asked.select(F.explode("cells").alias("cell")), len(centroids))
    return fetch(_final(_search_cells(_with_floor(asked, None), index, centroids, k, probes), k), index, columns)


def text_queries(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """A few questions at hand as a table of queries, numbered from 0."""
    rows = [(str(i), text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, query_text string")


def embed_queries(queries: DataFrame, embedder: Embedder, text: str = "query_text", **options) -> DataFrame:
    """Queries with query_vector; a query given with a vector keeps it."""
    vectors = embed(queries, embedder, text=text, by="query_id", keep_text=True, **options)
    new = F.col("embedding")
    if "query_vector" in queries.columns:
        new = F.coalesce(F.col("query_vector"), new)
    others = [c for c in queries.columns if c != "query_vector"]
    return vectors.select(*others, new.alias("query_vector"))
