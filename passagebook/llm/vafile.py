"""Exact top-k by inner product over a vector-approximation file.

Components become integers, floor(scale * x). The file holds, for each vector, the cell of
every component (one byte) beside the exact components. A search reads the cells first:
the ends of the cells bound each score from both sides. The kth best lower bound of any
part of the file is a floor under the kth best score of all, so a second scan reads exact
vectors only where the upper bound reaches the floor, in falling order of upper bound, and
stops as soon as the kth exact score lies above all bounds that are left.

Defined results: vectors that are null or empty or hold a null or non-finite component take
no part, nor do rows without an id. Only vectors of a query's length are its candidates. Every
repeated row is a candidate of its own; a query id that occurs twice is asked once, with
the smallest of its vectors. Ties go to the smaller id. An empty table gives no rows. Other
columns of the tables are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagebook.sources.session import materialize

#: Queries in one broadcast block: at most so many, and at most so many bytes.
BLOCK_QUERIES = 16384
BLOCK_BYTES = 32 << 20

_HITS = "query_no int, vec_id bigint, score bigint"


def integers(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, x): sound vectors with floor(scale * component) as long integers."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        vectors.select(F.col(ident).cast("long").alias("vec_id"), v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound & (F.size("v") > 0))
        .select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(scale))).alias("x"))
    )


def build(vectors: DataFrame, bits: int = 6, **columns) -> DataFrame:
    """The file, written to the shared folder: (vec_id, dim, low, step, cells, x).

    The ends of the cells are those of equal steps between the least and the greatest
    component of vectors of one length, so a row can be read without any other.
    """
    exact = integers(vectors, **columns)
    x = F.col("x")
    ends = exact.groupBy(F.size("x").alias("dim")).agg(
        F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")
    )
    # One row for each length of vectors: a handful, but not proven so, hence no hint.
    return materialize(
        exact.withColumn("dim", F.size("x"))
        .join(ends, "dim")
        .withColumn("step", F.greatest(F.lit(1), F.ceil((F.col("high").cast("double") - F.col("low") + 1) / (1 << bits))))
        .select("vec_id", "dim", "low", "step", F.transform(x, lambda c: F.floor((c.cast("double") - F.col("low")) / F.col("step")).cast("tinyint")).alias("cells"), "x"),
        "va-file",
    )


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _kind(dim: int, most: float) -> type:
    """The cheapest number type in which sums of products stay exact."""
    if most * most * max(dim, 1) < 2**24:
        return np.float32
    return np.float64 if most * most * max(dim, 1) < 2**53 else object


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[dict]:
    """Parts of batches, each of one length and so of one set of cells."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            where = np.flatnonzero(dims == dim)
            for s in range(0, len(where), rows):
                part = batch.take(pa.array(where[s : s + rows]))
                low, step = part.column("low")[0].as_py(), part.column("step")[0].as_py()
                cells = _flat(part.column("cells"), dim).astype(np.float64)
                yield {"dim": int(dim), "low": low, "step": step, "part": part, "cells": cells,
                       "ids": part.column("vec_id").to_numpy(zero_copy_only=False)}


def _bounds(q: np.ndarray, part: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, (queries, rows), rounded outwards."""
    near = part["low"] + part["cells"] * part["step"]
    base = q @ near.T
    width = part["step"] - 1
    down = (np.minimum(q, 0).sum(axis=1) * width)[:, None]
    up = (np.maximum(q, 0).sum(axis=1) * width)[:, None]
    return base + down, base + up


class _Search:
    """What the tasks of both scans share: a block of queries by length of vector."""

    def __init__(self, ids: np.ndarray, vectors: list, k: int):
        self.k, self.by_dim = k, {}
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            no = np.flatnonzero(dims == dim)
            exact = np.array([vectors[i] for i in no], dtype=np.int64).reshape(len(no), dim)
            self.by_dim[int(dim)] = (no, ids[no], exact)
        self.count = len(ids)

    def parts(self, batches: Iterator[pa.RecordBatch], strip: int = 2048):
        for part in _batches(batches):
            if part["dim"] in self.by_dim:
                no, ids, exact = self.by_dim[part["dim"]]
                most = float(max(np.abs(exact.astype(np.float64)).max(initial=0), abs(part["low"]), abs(part["low"] + 128.0 * part["step"])))
                kind = _kind(part["dim"], most)
                for s in range(0, len(no), strip):
                    # Bounds beyond 2**53 are widened by more than doubles can be off.
                    slack = 0 if kind is not object else most * most * part["dim"] * 2.0**-40
                    q = exact[s : s + strip]
                    yield part, no[s : s + strip], ids[s : s + strip], q, kind, slack


def _floors(search: _Search):
    """First scan: for each query the kth best lower bound in this part of the file."""

    def scan(batches):
        best = np.full((search.count, search.k), -np.inf)
        for part, no, ids, q, kind, slack in search.parts(batches):
            lower, _ = _bounds(q.astype(kind if kind is not object else np.float64), {**part, "cells": part["cells"].astype(kind if kind is not object else np.float64)})
            lower = lower - slack
            lower[ids[:, None] == part["ids"][None, :]] = -np.inf
            both = np.concatenate([best[no], lower], axis=1)
            best[no] = np.partition(both, both.shape[1] - search.k, axis=1)[:, -search.k :]
        floor = best.min(axis=1) if search.count else np.empty(0)
        known = np.flatnonzero(np.isfinite(floor))
        yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(floor[known])], ["query_no", "floor"])

    return scan


def _exact(q: np.ndarray, x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        scores = x.astype(object) @ q.astype(object)
        return np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], dtype=np.int64)
    return (x.astype(kind) @ q.astype(kind)).astype(np.int64)


def _refine(search: _Search, floors: np.ndarray):
    """Second scan: exact scores in falling order of upper bound, at most k rows a query."""

    def scan(batches):
        k = search.k
        held = {}  # query number -> (scores, ids), at most k, best first
        for part, no, ids, q, kind, slack in search.parts(batches):
            number = np.float64 if kind is object else kind
            _, upper = _bounds(q.astype(number), {**part, "cells": part["cells"].astype(number)})
            upper = upper + slack
            upper[ids[:, None] == part["ids"][None, :]] = -np.inf
            x = _flat(part["part"].column("x"), part["dim"])
            least = floors[no].copy()
            for r, n in enumerate(no):
                if n in held and len(held[n][0]) == k:
                    least[r] = max(least[r], held[n][0][-1])
            hit = upper >= least[:, None]
            hit &= np.isfinite(upper)
            for r in np.flatnonzero(hit.any(axis=1)):
                n, cand = no[r], np.flatnonzero(hit[r])
                cand = cand[np.argsort(-upper[r, cand], kind="stable")]
                scores, found = held.get(n, (np.empty(0, np.int64), np.empty(0, np.int64)))
                for s in range(0, len(cand), 4 * k):
                    some = cand[s : s + 4 * k]
                    if len(scores) == k and scores[-1] > upper[r, some[0]]:
                        break  # the kth is certain: no bound that is left reaches it
                    scores = np.concatenate([scores, _exact(q[r], x[some], kind)])
                    found = np.concatenate([found, part["ids"][some]])
                    order = np.lexsort((found, -scores.astype(np.float64) if kind is not object else [-int(v) for v in scores]))[:k]
                    scores, found = scores[order], found[order]
                held[n] = (scores, found)
        for s in range(0, len(held), 512):
            some = list(held.items())[s : s + 512]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([n for n, _ in some], np.int32), [len(h[0]) for _, h in some])),
                    pa.array(np.concatenate([h[0] for _, h in some])),
                    pa.array(np.concatenate([h[1] for _, h in some])),
                ],
                ["query_no", "score", "vec_id"],
            ).select(["query_no", "vec_id", "score"])

    return scan


def top_k(queries: DataFrame, file: DataFrame, k: int = 20, block_queries: int = BLOCK_QUERIES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best rows of a file for each query (vec_id, x): (query_id, rank, vec_id, score).

    Queries are taken in blocks of bounded bytes, for each of which the file is scanned
    where it lies: no vector is shuffled, and a task sends at most k rows for each query.
    """
    spark = queries.sparkSession
    asked = materialize(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "va-queries")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    per = max(1, min(block_queries, block_bytes // (8 * max(1, size.dim or 1))))
    blocks = -(-size.n // per)
    if blocks > 1:
        # Of equal size but for chance, hence the room left in each.
        blocks = -(-size.n * 5 // (per * 4))
        asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "va-blocks")
    found = None
    for b in range(blocks):
        block = (asked if blocks == 1 else asked.filter(F.col("block") == b)).select("vec_id", "x").toArrow()
        if block.num_rows == 0:
            continue
        ids = block.column("vec_id").to_numpy()
        search = _Search(ids, block.column("x").to_pylist(), k)
        sent = spark.sparkContext.broadcast(search)
        low = (
            file.select("vec_id", "dim", "low", "step", "cells")
            .mapInArrow(lambda it, sent=sent: _floors(sent.value)(it), "query_no int, floor double")
            .groupBy("query_no").agg(F.max("floor").alias("floor")).toArrow()
        )
        floors = np.full(len(ids), -np.inf)
        floors[low.column("query_no").to_numpy()] = low.column("floor").to_numpy()
        limits = spark.sparkContext.broadcast(floors)
        names = spark.createDataFrame(pa.table({"query_no": pa.array(np.arange(len(ids), dtype=np.int32)), "query_id": pa.array(ids)}))
        hits = file.mapInArrow(lambda it, sent=sent, limits=limits: _refine(sent.value, limits.value)(it), _HITS).join(names, "query_no")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = (
            hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )
        best = materialize(best, "va-best") if blocks > 1 else best
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found
