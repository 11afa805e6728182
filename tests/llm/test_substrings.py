import hashlib
import random

import numpy as np
import pytest

from passagebook.llm import substrings
from passagebook.llm.queries import op8_substring_dedup


def plain_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(rows, size):
    """(id, text) -> (words, removed, kept) of every row, by all windows."""
    key = lambda i: (1 << 63) - 1 if i is None else i
    least = {}
    for i, t in rows:
        w = plain_words(t)
        for s in range(len(w) - size + 1):
            gram = tuple(w[s : s + size])
            least[gram] = min(key(i), least.get(gram, key(i)))
    out = []
    for i, t in rows:
        w = plain_words(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if least[tuple(w[s : s + size])] < key(i):
                gone |= set(range(s, s + size))
        out.append((str(i), len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in df.collect())


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 41):
        assert substrings.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


# The last two sketches are far too small: most counts are too high, and nothing is lost.
@pytest.mark.parametrize("width", [1 << 20, 256, 2])
def test_equals_all_windows(spark, width):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["é", "日本"]
    passages = [rng.choices(words, k=n) for n in (12, 15, 30, 11, 10, 9)]
    rows = []
    for i in range(400):
        body = rng.choices(words, k=rng.randint(0, 40))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t \n"]).join(body)))
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(1000, "a " * 25), (None, rows[3][1]), (None, rows[5][1]), (7, rows[7][1])]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a " * 30), (2004, "a " * 30)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, kept_text string, doc int")
    got = substrings.dedup(df, size=10, width=width, depth=2).withColumnRenamed("kept_text", "own").withColumnRenamed("kept_text_", "kept_text")
    assert rows_of(got) == plain(rows, 10)
    assert substrings.dedup(df.limit(0), size=10, width=256).count() == 0


def test_hot_windows(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(700)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=1 << 16)
    assert rows_of(got) == plain(rows, 50)


def test_long_text(spark):
    rows = [(1, "u " * 300000), (0, "u " * 60)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=1 << 16)
    assert rows_of(got) == [("0", 60, 0, ("u " * 60).strip()), ("1", 300000, 300000, "")]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in plain(rows, 50)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in op8_substring_dedup(spark, sf).collect())
    assert got == want
