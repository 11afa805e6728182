import hashlib
import math
import random

import numpy as np
import pytest

from passagebook.llm import bitplanes
from passagebook.llm import planeclusters as c

SCHEMA = "vec_id long, embedding array<double>, cluster int, Distance string, planes int"


@pytest.mark.parametrize("top", [1, 3, 64, 1 << 20])
def test_planes_are_exact(top):
    rng = np.random.default_rng(1)
    x, y = rng.integers(-top, top, (50, 64)), rng.integers(-top // 2, top * 2, (7, 64))
    p, q = bitplanes.row_planes(x), bitplanes.row_planes(y)
    assert np.array_equal(bitplanes.row_integers(p), x)
    assert np.array_equal(bitplanes.products(p, q), x @ y.T)
    assert np.array_equal(bitplanes.squares(p), (x * x).sum(axis=1))


def test_fewest_planes():
    assert bitplanes.row_planes(np.zeros((2, 64), np.int64)).shape == (2, 1)
    assert bitplanes.row_planes(np.full((2, 64), -64)).shape == (2, 7)
    assert bitplanes.row_planes(np.full((2, 64), 64)).shape == (2, 8)


def plain(rows, k, rounds):
    """All distances, one after the other."""
    kept = [(i, [math.floor(64 * v) for v in e]) for i, e in rows if e is not None and len(e) == 64 and all(v is not None and math.isfinite(v) for v in e)]
    mark = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, mark(r[0])))
    centres = [list(x) for _, x in order[:k]]

    def nearest(x):
        far = [sum((a - b) ** 2 for a, b in zip(x, m)) for m in centres]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        at = [nearest(x)[0] for _, x in kept]
        for j in set(at):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            centres[j] = [sum(v) // len(own) for v in zip(*own)]
    found = [(i, *nearest(x)) for i, x in kept]
    total = sum(f[2] for f in found)
    marks = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres]
    return sorted(((str(i), j, d, sum(f[2] for f in found if f[1] == j), total, marks[j]) for i, j, d in found))


def vectors(seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(300)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(200)]  # a hot vector
    rows += [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [None] + [0.1] * 63)]
    rows += [(2005, [math.nan] + [0.1] * 63), (2006, [-math.inf] + [0.1] * 63), (None, [0.3] * 64), (None, [-0.3] * 64)]
    return rows + [rows[5], rows[5], (3000, [0.0] * 64), (3001, [1000.0] * 64)]


def result(spark, rows, k, rounds):
    df = spark.createDataFrame([(*r, 7, "clash", 1) for r in rows], SCHEMA).repartition(6)
    found = c.with_inertia(c.cluster(df, k=k, rounds=rounds))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in found.collect())


@pytest.mark.parametrize("k,rounds", [(16, 3), (1, 2), (5, 0)])
def test_equals_plain(spark, k, rounds):
    assert result(spark, vectors(), k, rounds) == plain(vectors(), k, rounds)


def test_fewer_vectors_than_clusters_and_rows_without_id(spark):
    rows = [(4, [0.5] * 64), (None, [0.1] * 64), (4, [0.5] * 64)]
    assert result(spark, rows, 16, 3) == plain(rows, 16, 3)


def test_empty_clusters_stay(spark):
    # Equal starts: the smaller number gets every tie, the other centroid keeps its place.
    rows = [(i, [0.25] * 64) for i in range(20)]
    found = result(spark, rows, 4, 3)
    assert {r[1] for r in found} == {0} and found == plain(rows, 4, 3)


def test_empty_table(spark):
    assert result(spark, [], 16, 3) == []
    assert result(spark, [(1, None), (2, [1.0])], 16, 3) == []


def test_refuses_what_would_not_be_exact(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="in amount"):
        c.cluster(df)
    with pytest.raises(ValueError):
        c.cluster(df, k=0)
