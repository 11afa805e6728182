"""Approximate top-k by product quantisation within cells.

An index row is entered in its nearest cells (one or a few: its copies) as a code: what is
left of the vector without the cell's centroid is cut into parts, and each part is named by
the nearest of up to 256 entries of a codebook. A search reads the codes of the cells nearest to
a query, and no vectors: the score of a code is the query's product with the centroid plus,
for each part, a number looked up in the query's table of products with the codebook. The best
by that score, some times k of them, are fetched by id and scored exactly.

Cells are more and smaller than the root of the rows asks for, since ten cells of ten rows
follow the neighbourhood of a query better than one of a hundred. Copies buy recall where
neighbours lie across the border of cells; how many are needed is measured on the sample.

Centroids and codebooks are learned from a bounded sample by the hash of the id; every row is
encoded. Codebooks are learned part by part, one group for each part of the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.functions.vectors import has_vector, matrix
from passagebook.operators import search
from passagebook.operators.indexing import train_cells
from passagebook.sources.session import materialize

# Rows that centroids and codebooks are learned from, and those by which copies are chosen.
SAMPLE_ROWS = 65_536
TUNING_ROWS, TUNING_QUERIES = 10_000, 200

# Entries of a codebook: a code of a part is one byte.
CODES = 256

# Most cells: their centroids are sent to every task.
CELLS = 8192

# A query reads at most this share of the cells.
SHARE = 0.1

_ROUNDS = 10

# Vectors compared with all cells at once.
_STRIP = 256


@dataclass(frozen=True)
class Quantiser:
    """centroids: (cells, dim). codebooks: (parts, codes, dim / parts), of what a centroid leaves."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centroids)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def probes(self, share: float = SHARE) -> int:
        """Cells that a query reads: the share, rounded down, but one at least."""
        return max(1, int(self.cells * share))

    def near(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """Numbers of the nearest cells of each vector, nearest first."""
        half, out = (self.centroids * self.centroids).sum(axis=1) / 2, np.empty((len(vectors), count), np.int32)
        for at in range(0, len(vectors), _STRIP):
            scores = vectors[at : at + _STRIP] @ self.centroids.T - half
            out[at : at + _STRIP] = scores.argmax(axis=1)[:, None] if count == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :count]
        return out

    def codes(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(n, parts) bytes: for each part the nearest entry of its codebook."""
        parts, _, width = self.codebooks.shape
        left = (vectors - self.centroids[cells]).reshape(len(vectors), parts, width)
        out = np.empty((len(vectors), parts), np.uint8)
        for p, book in enumerate(self.codebooks):
            out[:, p] = (left[:, p] @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(parts, n, codes): products of each part of each query with each entry."""
        parts, _, width = self.codebooks.shape
        return np.einsum("npw,pcw->pnc", queries.reshape(len(queries), parts, width), self.codebooks)


class _Looked(search._Best):
    """The best codes of a cell, by looked-up scores."""

    def __init__(self, query_ids, queries, k, floor, quantiser: Quantiser, cell: int):
        super().__init__(query_ids, queries, k, floor)
        self.table = quantiser.tables(queries)
        self.base = queries @ quantiser.centroids[cell]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[:, None], len(codes), axis=1)
        for table, column in zip(self.table, codes.T):
            out += table[:, column]
        return out


def _by_hash(index: DataFrame, rows: int, salt: int) -> DataFrame:
    """At most about `rows` rows, by the hash of their id."""
    total = index.count()
    if total <= rows:
        return index
    return index.filter(F.pmod(F.xxhash64(F.lit(salt), "chunk_id"), F.lit(1_000_003)) < F.lit(int(rows * 1_000_003 / total)))


def cell_count(rows: int, most: int = CELLS) -> int:
    """Four times the root of the rows, but at least five rows a cell."""
    return max(1, min(most, 4 * math.isqrt(rows), rows // 5))


def _codebook(points: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Centres of k-means over the points of one part, without repeated ones."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= codes:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), codes, replace=False)]
    for _ in range(_ROUNDS):
        own = (points @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(own, minlength=codes)
        total = np.stack([np.bincount(own, weights=column, minlength=codes) for column in points.T], axis=1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def learn(
    index: DataFrame, cells: int | None = None, parts: int | None = None, codes: int = CODES,
    sample_rows: int = SAMPLE_ROWS, seed: int = 42,
) -> Quantiser:
    """Centroids and codebooks of an index (chunk_id, embedding), whose vectors have one length.

    `parts` is the bytes of a code, by default half the vector's values. Both are learned from
    at most about `sample_rows` rows.
    """
    if not 1 <= codes <= 256:
        raise ValueError("a code is one byte")
    rows = index.filter(has_vector(F.col("embedding"))).select("chunk_id", "embedding")
    sample = materialize(_by_hash(rows, sample_rows, seed), "quantiser-sample")
    centroids = train_cells(sample, cells or cell_count(rows.count()), seed, sample=None)
    dim = centroids.shape[1]
    parts = parts or max(1, dim // 2)
    if dim % parts:
        raise ValueError(f"vectors of {dim} values cannot be cut into {parts} equal parts")
    width = dim // parts

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Quantiser(centroids, np.zeros((parts, 1, width)))
        for batch in batches:
            vectors = matrix(batch.column("embedding"), dim)
            left = vectors - centroids[plain.near(vectors, 1)[:, 0]]
            number = np.tile(np.arange(parts, dtype=np.int32), len(vectors))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(number) * width + 1, width, dtype=np.int32)), pa.array(left.ravel()))
            ids = pa.array(np.repeat(np.arange(len(vectors)), parts))
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column("chunk_id").take(ids), values], ["part", "chunk_id", "piece"])

    def train(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("chunk_id", kind="stable")  # whatever the shuffle's order
        book = _codebook(np.stack(pieces["piece"].to_numpy()).astype(np.float64), codes, seed)
        return pd.DataFrame({"part": int(pieces["part"].iloc[0]), "code": np.arange(len(book)), "entry": list(book)})

    pieces = sample.mapInArrow(split, "part int, chunk_id string, piece array<double>")
    books = pieces.groupBy("part").applyInPandas(train, "part int, code int, entry array<double>").toArrow().to_pydict()
    codebooks = np.full((parts, codes, width), np.nan)
    for part, code, entry in zip(books["part"], books["code"], books["entry"]):
        codebooks[part, code] = entry
    # Entries that a small sample does not fill repeat the first and are never chosen before it.
    codebooks = np.where(np.isnan(codebooks), codebooks[:, :1], codebooks)
    return Quantiser(centroids, codebooks)


def choose_copies(index: DataFrame, quantiser: Quantiser, k: int = 10, target: float = 0.95, share: float = SHARE, most: int = 8) -> int:
    """The fewest copies with which cells hold the target share of true neighbours, for a
    bounded sample of queries among a bounded sample of rows. Neighbours in a sample lie further
    off than those among all rows, so the true recall of cells is rather higher."""
    sample = _by_hash(index.filter(has_vector(F.col("embedding")) & (F.size("embedding") == quantiser.dim)), TUNING_ROWS, 7)
    rows = matrix(sample.select("embedding").toArrow().column("embedding"), quantiser.dim)
    queries = rows[: min(TUNING_QUERIES, len(rows))]
    near = np.stack([np.argsort(-(rows @ q), kind="stable")[:k] for q in queries])
    homes, probed = quantiser.near(rows, min(most, quantiser.cells)), quantiser.near(queries, quantiser.probes(share))
    for copies in range(1, homes.shape[1] + 1):
        met = (homes[near][:, :, :copies, None] == probed[:, None, None, :]).any(axis=(2, 3))
        if met.mean() >= target:
            return copies
    return homes.shape[1]


def encode(index: DataFrame, quantiser: Quantiser, copies: int = 1, columns: Sequence[str] = ()) -> DataFrame:
    """(cell, chunk_id, code, columns): each row once for each of its nearest cells. Vectors of
    another length, or with NaN or infinite values, are left out."""
    rows = index.filter(has_vector(F.col("embedding")) & (F.size("embedding") == quantiser.dim)).select("chunk_id", *columns, "embedding")
    kept = ["chunk_id", *columns]
    sent = index.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            vectors = matrix(batch.column("embedding"), q.dim)
            sound = np.isfinite(vectors).all(axis=1)
            batch, vectors = batch.filter(pa.array(sound)), vectors[sound]
            for at in range(0, len(vectors), 1024):
                part = vectors[at : at + 1024]
                cells = q.near(part, min(copies, q.cells))
                row = np.repeat(np.arange(len(part)), cells.shape[1])
                codes = q.codes(part[row], cells.ravel())
                out = batch.select(kept).slice(at, len(part)).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel().astype(np.int32)), *out.columns, pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", *kept, "code"]
                )

    schema = "cell int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema) + ", code binary"
    return rows.mapInArrow(run, schema)


def candidates(queries: DataFrame, codes: DataFrame, quantiser: Quantiser, keep: int, probes: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score): the `keep` best codes of each query by looked-up score.

    `codes` is what encode made, stored by cell. The nearest cells of a query, an eighth of
    those it reads, are searched first: the score of the last place there is a floor below
    which the others send nothing.
    """
    probes = probes or quantiser.probes()
    asked = search.ask_cells(queries, quantiser.centroids, probes)
    codes = search.only_cells(codes, asked, quantiser.cells)
    sent = codes.sparkSession.sparkContext.broadcast(quantiser)

    def held(parts):
        packed = pa.Table.from_batches([p.select(["chunk_id", "code"]) for p in parts]).combine_chunks()
        code = np.frombuffer(b"".join(packed.column("code").to_pylist()), np.uint8).reshape(packed.num_rows, -1)
        return np.asarray(packed.column("chunk_id").to_pylist(), dtype=object), code

    def best(cell, kept, ids, vectors, floors):
        found = _Looked(ids, vectors, keep, floors.copy(), sent.value, cell)
        found.add(*kept)
        yield from found.batches()

    def looked(some: DataFrame, floors: DataFrame | None) -> DataFrame:
        both = search._in_slices(search._with_floor(some, floors), codes, "code", search.INDEX_BLOCK)
        return both.mapInArrow(search._meet(held, best), search._FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        # A row found in several of its cells counts once.
        once = found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        return search._final(once, keep)

    first = max(1, probes // 8)
    near = materialize(ranked(looked(asked.filter(F.col("place") < first), None)), "near-codes")
    if first == probes:
        return near.drop("rank")
    floors = near.filter(F.col("rank") == keep).select("query_id", F.col("score").alias("floor"))
    rest = looked(asked.filter(F.col("place") >= first), floors)
    return ranked(near.select("query_id", "score", "chunk_id").unionByName(rest)).drop("rank")


def rescore(queries: DataFrame, found: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, score, chunk_id): the k best of the rows found, by their exact scores."""
    found = materialize(found.select("query_id", "chunk_id"), "candidates")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query_vector")
    pairs = found.join(index.select("chunk_id", "embedding"), "chunk_id").join(asked, "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, wanted = matrix(batch.column("embedding")), matrix(batch.column("query_vector"))
                score = np.round(np.einsum("nd,nd->n", rows, wanted), search.SCORE_DIGITS) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(score), batch.column("chunk_id")], ["query_id", "score", "chunk_id"])

    exact = pairs.select("query_id", "chunk_id", "embedding", "query_vector").mapInArrow(run, search._FOUND)
    return search._final(exact, k)


def top_k(
    queries: DataFrame, index: DataFrame, codes: DataFrame, quantiser: Quantiser, k: int = 10, probes: int | None = None,
    keep: int | None = None, filters: Mapping[str, object] | None = None, columns: Sequence[str] = (),
) -> DataFrame:
    """The k rows nearest to each query among the `keep` (ten times k by default) best codes of
    the cells it reads: (query_id, rank, score, chunk_id, columns), with exact scores.

    Filters name columns that the codes carry, and hold before anything is ranked.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    keep = max(k, 10 * k if keep is None else keep)
    found = candidates(queries, search.with_filters(codes, filters), quantiser, keep, probes)
    return search.fetch(rescore(queries, found, index, k), index, columns)
