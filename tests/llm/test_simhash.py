import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from passagebook.llm import simhash
from passagebook.llm.components import components


def plain_fingerprint(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    prints = sorted(set(prints))
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def flipped(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def as_long(value):
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_equal_all_pairs(spark, most):
    rng = random.Random(most)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for base in prints[:40]:
        prints += [flipped(rng, base, rng.choice([1, 1, 2, 2, 3, 4, 5])) for _ in range(4)]
    # A large group: copies that differ in a few neighbouring bits only.
    prints += [prints[0] ^ (rng.getrandbits(9) << 3) for _ in range(300)]
    df = spark.createDataFrame([(as_long(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, most)).collect()}
    want = {as_long(p): as_long(r) for p, r in plain_components(prints, most).items()}
    groups, expected = {}, {}
    for p in want:
        groups.setdefault(got.get(p, p), set()).add(p)
        expected.setdefault(want[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_large_groups_in_parts(spark):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 21, 20000).astype(np.uint64) << np.uint64(5))
    a, b = simhash._large(fps, list(range(5, 26)), 2)
    assert (np.bitwise_count(fps[a] ^ fps[b]) <= 2).all()
    root = simhash._stars(len(fps), a, b)
    where = {int(f): i for i, f in enumerate(fps)}
    for i in range(0, len(fps), 97):
        for x in range(5, 26):
            for y in range(x, 26):
                other = where.get(int(fps[i]) ^ (1 << x) ^ (1 << y if y != x else 0))
                assert other is None or root[other] == root[i]


def test_documents_and_odd_rows(spark, sf):
    rows = [
        (5, "One two THREE four five six"), (2, "one two three four five six"), (9, None), (7, ""), (8, " \n\t"),
        (3, "word"), (3, "word"), (None, "one two three four five six"), (11, "x " * 200000), (12, "é ü ÀB"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, fp string, k1 int")
    got = simhash.near_duplicates(df, size=3, most=2).collect()
    prints = {(i, t): plain_fingerprint(t, 3) for i, t in rows}
    roots = plain_components(prints.values(), 2)
    ids = {}
    for (i, _), p in prints.items():
        if i is not None:
            ids[roots[p]] = min(i, ids.get(roots[p], i))
    want = sorted((str(i), as_long(prints[i, t]), ids[roots[prints[i, t]]]) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in got) == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_plain(spark, sf):
    from passagebook.llm.queries import op5_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r.doc_id: plain_fingerprint(r.text, 3) for r in docs}
    roots = plain_components(prints.values(), 2)
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(roots[p], i)
    want = {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_large_groups_lose_no_link(most):
    """Members that meet after flips and those between them, for odd and even distances."""
    rng = np.random.default_rng(most)
    for _ in range(40):
        free = [int(b) for b in rng.choice(64, 10 if most < 4 else 12, replace=False)]
        size = int(rng.integers(5, 150))
        fps = np.unique(np.array([sum(1 << b for b in free if rng.random() < 0.5) for _ in range(size)], np.uint64))
        a, b = simhash._large(fps, free, most)
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= most).all()
        x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most, 1))
        assert np.array_equal(simhash._stars(len(fps), a, b), simhash._stars(len(fps), x, y))
