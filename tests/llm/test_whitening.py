import math
import random

import numpy as np
import pytest

from passagebook.llm import bitplanes
from passagebook.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, component int, Whitened string, dim int"


@pytest.mark.parametrize("rows,dim,top", [(1, 3, 5), (64, 5, 128), (200, 7, 1 << 20), (130, 4, 1 << 50)])
def test_cross_products_are_exact(rows, dim, top):
    rng = random.Random(3)
    y = [[rng.randrange(top) for _ in range(dim)] for _ in range(rows)]
    want = [[sum(r[d] * r[e] for r in y) for e in range(dim)] for d in range(dim)]
    assert bitplanes.cross_products(np.array(y, np.int64)).tolist() == want


def vectors(seed=1, n=300, dim=40):
    rng = random.Random(seed)
    mixed = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(dim)]
    out = []
    for i in range(n):
        z = [rng.gauss(0, 0.1 * (j + 1) ** 0.5) for j in range(dim)]
        out.append((i, [sum(a * b for a, b in zip(z, m)) for m in mixed]))
    out += [(1000 + i, list(out[7][1])) for i in range(150)]  # a hot vector
    bad = [(2000, None), (2001, [None] + [0.0] * (dim - 1)), (2002, [math.nan] * dim), (2003, [math.inf] * dim), (2004, [])]
    return out + bad + [(None, [0.5] * dim), out[3]]


def sound(rows, dim):
    return [(i, [math.floor(64 * c) for c in e]) for i, e in rows if e is not None and len(e) == dim and all(c is not None and math.isfinite(c) for c in e)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash", 1) for r in rows], SCHEMA).repartition(5)


def check(found, rows, dim, components=32):
    """Against numpy in long doubles and plain integers."""
    kept = sound(rows, dim)
    x = np.array([v for _, v in kept], np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    centred = (x - s.astype(np.longdouble) / n).astype(float)
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert sorted((str(r.vec_id), int(r.deviation)) for r in found if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(kept, exact))
    assert len(found) == n * min(components, dim) and {r.n for r in found} == {n}
    for c in range(1, min(components, dim) + 1):
        got = sorted((str(r.vec_id), r.whitened) for r in found if r.component == c)
        want = sorted((str(i), p) for (i, _), p in zip(kept, centred @ axes[:, c - 1] / np.sqrt(values[c - 1])))
        a, b = np.array([g[1] for g in got]), np.array([g[1] for g in want])
        assert min(np.abs(np.sort(a) - np.sort(b)).max(), np.abs(np.sort(a) - np.sort(-b)).max()) < 1e-6
        assert {r.explained for r in found if r.component == c}.pop() == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
    errors = {r.identity_error for r in found}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_equals_plain(spark):
    rows = vectors()
    df = frame(spark, rows)
    check(w.by_component(df).collect(), rows, 40)
    assert w.by_component(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_values_stay_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * 2.0**30 for _ in range(5)]) for i in range(60)]
    check(w.by_component(frame(spark, rows)).collect(), rows, 5)


def test_layout_changes_nothing(spark):
    rows = vectors(n=80, dim=6)
    one, many = (w.fit(frame(spark, rows).repartition(k))[6] for k in (1, 9))
    assert one.sums == many.sums and np.array_equal(one.values, many.values) and np.array_equal(one.vectors, many.vectors)


def test_each_length_is_a_fit_of_its_own(spark):
    a, b = vectors(n=90, dim=4), [(9000 + i, v) for i, v in vectors(2, 70, 3) if i is not None]
    found = w.by_component(frame(spark, a + b)).collect()
    ids = {i for i, _ in sound(b, 3)}
    counts = {r.n for r in found if r.vec_id in ids}
    assert counts == {len(sound(b, 3))}
    check([r for r in found if r.n not in counts], a, 4)


def test_directions_without_variance(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1), 0.5, rng.gauss(0, 1)]) for i in range(50)]
    found = w.by_component(frame(spark, rows)).collect()
    assert all((r.whitened is None) == (r.component == 3) for r in found)
    assert found[0].identity_error < 1e-9
    alone = w.by_component(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, None, None)] * 2


def test_empty(spark):
    assert w.by_component(frame(spark, [])).count() == 0
    assert w.by_component(frame(spark, [(1, None), (2, []), (3, [math.nan])])).count() == 0
