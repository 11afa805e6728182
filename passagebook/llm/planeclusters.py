"""Centroid clustering of vectors with 64 components by bit planes.

Components become integers, floor(scale * x). Each bit plane of a vector's 64 integers is one
64-bit word, so a vector of 7-bit integers is seven words. The dot product of a vector with a
centroid is the sum, over pairs of their planes, of the number of bits both set, times the
planes' weights: exact, as are the squared distances that follow from it.

Vectors are packed once, into the shared folder, and stay where they lie: each round
scans them with all centroids and sends home, for each task and cluster, a count and 64
sums, which are added up as partial aggregates. What reaches the driver is one row a cluster.

Defined results: vectors that are null, or hold a null or non-finite component, or have
another number of components take no part. Rows without an id are clustered, but start a
centroid only where rows with an id are too few. Repeated rows each count and each come
back; rows of one id start centroids in the order of their vectors. Fewer vectors than
clusters make as many clusters as there are vectors; an empty table gives no rows. Integers
of 2**27 or more in amount are an error, since distances would not fit a long. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.llm import bitplanes
from passagebook.sources.session import materialize

COMPONENTS = 64
MOST = 1 << 27
#: Rows whose distances are held at once.
STRIP = 8192


@dataclass
class Clusters:
    """Rows (vec_id, cluster, distance), and the centroids they were last assigned to."""

    rows: DataFrame
    centroids: list[list[int]]


def pack(vectors: DataFrame, scale: int = 64, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, planes): the words of each sound vector, written to the shared folder."""

    def run(batches):
        for batch in batches:
            for dim, rows, x in bitplanes.sound_integers(batch.column(1), scale, MOST):
                if dim == COMPONENTS:
                    words = np.ascontiguousarray(bitplanes.row_planes(x))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "planes"]
                    )

    named = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return materialize(named.mapInArrow(run, "vec_id long, planes binary"), "planes")


def _parts(batch: pa.RecordBatch):
    """(rows, words) of a packed batch, by number of planes."""
    sizes = np.array([len(p) for p in batch.column(1).to_pylist()])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for s in range(0, len(rows), STRIP):
            some = rows[s : s + STRIP]
            words = np.frombuffer(b"".join(batch.column(1).take(pa.array(some)).to_pylist()), np.uint64)
            yield some, words.reshape(len(some), size // 8)


def _nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number on a tie, and the squared distance."""
    far = bitplanes.squares(words)[:, None] + bitplanes.squares(centroids)[None, :] - 2 * bitplanes.products(words, centroids)
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(words)), cluster]


def _sums(centroids: list[list[int]]):
    """Over packed rows: (cluster, n, sums) of a task."""

    def run(batches):
        planes = bitplanes.row_planes(np.array(centroids, np.int64))
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), COMPONENTS), np.int64)
        for batch in batches:
            for _, words in _parts(batch):
                cluster, _ = _nearest(words, planes)
                by = np.argsort(cluster, kind="stable")
                found, first, n = np.unique(cluster[by], return_index=True, return_counts=True)
                count[found] += n
                total[found] += np.add.reduceat(bitplanes.row_integers(words[by]), first, axis=0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
        )

    return run


def _assign(centroids: list[list[int]]):
    def run(batches):
        planes = bitplanes.row_planes(np.array(centroids, np.int64))
        for batch in batches:
            for rows, words in _parts(batch):
                cluster, far = _nearest(words, planes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"]
                )

    return run


def starts(packed: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors whose ids have the smallest sha256 of `salt:id`, in the order of the hash."""
    hashed = packed.withColumn("mark", F.sha2(F.concat_ws(":", F.lit(salt), F.col("vec_id").cast("string")), 256))
    first = hashed.orderBy(F.col("vec_id").isNull(), "mark", "planes").limit(k).select("planes").toArrow().column(0).to_pylist()
    return [bitplanes.row_integers(np.frombuffer(p, np.uint64)[None, :])[0].tolist() for p in first]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1", ident: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Vectors in k clusters after so many rounds, and one last assignment."""
    if k < 1 or rounds < 0:
        raise ValueError("there must be a cluster, and no negative number of rounds")
    packed = pack(vectors, scale, ident, vector)
    centroids = starts(packed, k, salt)
    if not centroids:
        return Clusters(vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), [])
    for _ in range(rounds):
        added = packed.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>").groupBy("cluster").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d].cast("decimal(38,0)")) for d in range(COMPONENTS)]).alias("sums")
        )
        for row in added.toLocalIterator():  # one row a cluster
            centroids[row.cluster] = [int(s) // row.n for s in row.sums]
    return Clusters(materialize(packed.mapInArrow(_assign(centroids), "vec_id long, cluster int, distance long"), "clusters"), centroids)


def digests(centroids: list[list[int]]) -> list[str]:
    """sha256 of each centroid's components as decimal integers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


def with_inertia(clusters: Clusters) -> DataFrame:
    """The rows with the distance summed over their cluster and over all, and the digest of
    their centroid. One row a cluster is joined, which is a number the caller has chosen."""
    marks = digests(clusters.centroids)
    each = clusters.rows.groupBy("cluster").agg(F.sum("distance").alias("total")).toLocalIterator()
    totals = {row.cluster: row.total for row in each}
    known = clusters.rows.sparkSession.createDataFrame(
        [(c, total, sum(totals.values()), marks[c]) for c, total in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return clusters.rows.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
