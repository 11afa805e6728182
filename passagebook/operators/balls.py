"""Exact top-k that reads cells in the order of what they can hold at best.

Each cell of an index is a ball: its centre, and the distance of its furthest row. No row of a
cell scores more against a query than the query's product with the centre plus its length
times the radius, nor more than its length times that of the longest row. A query visits its
cells in falling order of that bound, in waves that grow; its search is over as soon as the
kth score found lies above the bounds of all cells left. Each wave is one meeting of the
queries still open with the rows of the cells they want, and reads no other cell.

Where rows lie in clusters a query reads few cells; where they fill the space evenly, as
random vectors of many values do, no ball can be left out and all are read, once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.functions.vectors import has_vector, matrix
from passagebook.operators import search
from passagebook.sources.session import materialize

# Cells of the first wave, and how much larger each wave is than all before it.
FIRST, GROWTH = 2, 4

# Scores are rounded, bounds are not: a cell is left out only if it is lower by more than that.
_SLACK = 2 * 10.0**-search.SCORE_DIGITS


@dataclass(frozen=True)
class Balls:
    """An index with its cells, and centre, radius and longest row of each cell."""

    index: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    lengths: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, cells): no row of a cell scores more; -inf for cells without rows."""
        size = np.sqrt((queries * queries).sum(axis=1))[:, None]
        return np.minimum(queries @ self.centres.T + size * self.radii, size * self.lengths)


def build(index: DataFrame, centres: np.ndarray, path: str) -> Balls:
    """The index written by nearest centre, and what its balls measure. Rows with NaN or
    infinite values, or of another length than the centres, have no score and are left out."""
    celled = search.assign_cells(index, centres)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    stored = search.write_cells(celled.filter(sound), path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, long = np.full(len(centres), -np.inf), np.full(len(centres), -np.inf)
        for batch in batches:
            vectors = matrix(batch.column("embedding"), centres.shape[1])
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            np.maximum.at(far, cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(axis=1)))
            np.maximum.at(long, cell, np.sqrt((vectors * vectors).sum(axis=1)))
        held = np.flatnonzero(np.isfinite(far))
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(far[held]), pa.array(long[held])], ["cell", "far", "long"])

    parts = stored.select("embedding", "cell").mapInArrow(measure, "cell int, far double, long double")
    known = parts.groupBy("cell").agg(F.max("far").alias("far"), F.max("long").alias("long")).toArrow()  # one row a cell
    radii, lengths = np.full(len(centres), -np.inf), np.full(len(centres), -np.inf)
    cells = known.column("cell").to_numpy()
    # Rounded up by more than sums of squares can be off.
    radii[cells] = known.column("far").to_numpy() * (1 + 1e-12) + 1e-12
    lengths[cells] = known.column("long").to_numpy() * (1 + 1e-12) + 1e-12
    return Balls(stored, centres, radii, lengths)


def _wanted(sent, first: int, last: int):
    """Over open queries: a row for each cell of the wave, those ranked first to last by bound,
    that can still hold one of the best; and whether cells are left behind the wave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            bound = Balls(None, *balls).bounds(matrix(batch.column("query_vector")))
            floor = batch.column("floor").to_numpy()
            order = np.argsort(-bound, axis=1, kind="stable")
            sorted_bound = np.take_along_axis(bound, order, axis=1)
            can = np.isfinite(sorted_bound) & (sorted_bound + _SLACK >= floor[:, None])
            row, place = np.nonzero(can[:, first:last])
            more = can[:, last:].any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(["query_id", "query_vector", "floor"]).take(pa.array(row)).columns,
                    pa.array(order[row, first + place].astype(np.int32)), pa.array(more[row]),
                ],
                ["query_id", "query_vector", "floor", "cell", "more"],
            )

    return run


def top_k(
    queries: DataFrame, balls: Balls, k: int = 10, filters: Mapping[str, object] | None = None, columns: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The k rows nearest to every query, exactly as search.top_k, and what each query read:
    (query_id, n_cells)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    index, cells = search.with_filters(balls.index, filters), len(balls.centres)
    sent = index.sparkSession.sparkContext.broadcast((balls.centres, balls.radii, balls.lengths))
    fits = has_vector(F.col("query_vector")) & (F.size("query_vector") == balls.centres.shape[1])
    finite = F.forall("query_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = materialize(queries.filter(fits & finite).select(F.col("query_id").cast("string").alias("query_id"), "query_vector"), "asked")
    found, reads, first, last = None, None, 0, min(FIRST, cells)
    while True:
        floors = None if found is None else found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        schema = f"query_id string, query_vector {asked.schema['query_vector'].dataType.simpleString()}, floor double, cell int, more boolean"
        wave = materialize(search._with_floor(asked, floors).mapInArrow(_wanted(sent, first, last), schema), "wave")
        visited = wave.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_cells"))
        reads = visited if reads is None else reads.unionByName(visited)
        if not wave.isEmpty():
            new = search._search_grouped(wave.drop("more"), search.only_cells(index, wave, cells), k)
            new = new if found is None else found.select("query_id", "score", "chunk_id").unionByName(new)
            found = materialize(search._final(new, k), "wave-best")
        elif found is None:
            found = index.sparkSession.createDataFrame([], "query_id string, rank int, score double, chunk_id string")
        if last >= cells or wave.filter("more").isEmpty():
            break
        # A query none of whose cells of this wave can hold more has none behind it either.
        asked = materialize(asked.join(wave.filter("more").select("query_id").distinct(), "query_id", "left_semi"), "open")
        first, last = last, min(cells, last * (1 + GROWTH))
    reads = reads.groupBy("query_id").agg(F.sum("n_cells").cast("int").alias("n_cells"))
    return search.fetch(found, index, columns), reads
