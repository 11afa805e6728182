import random

import numpy as np
import pytest

from passagebook.llm import quality as q
from passagebook.llm.queries import op2_quality


def plain_peaks(net, text):
    """Every chunk by itself."""
    data = list(text) + [0] * (max(q.WINDOW, -(-len(text) // q.STRIDE) * q.STRIDE) - len(text))
    best = np.full(q.FILTERS, -np.inf)
    for s in range(0, len(data) - q.WINDOW + 1, q.STRIDE):
        best = np.maximum(best, net.embed[data[s : s + q.WINDOW]].reshape(-1) @ net.filters)
    return best


@pytest.mark.parametrize("size", [0, 1, 15, 16, 17, 21, 300, q.STRIP + 50])
def test_peaks_cover_the_text(size, monkeypatch):
    monkeypatch.setattr(q, "STRIP", 64) if size < 1000 else None
    text = bytes(random.Random(size).choices(range(256), k=size))
    best, at = q.Net(3).peaks(text)
    assert best == pytest.approx(plain_peaks(q.Net(3), text), abs=1e-4)
    assert (at % q.STRIDE == 0).all() and at.max() <= max(0, size + q.STRIDE - q.WINDOW)


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(rng.randint(5, 60))]
        if i % 3 == 0:
            words[len(words) // 2 :] = ["#%!" * 3] * 3
        out.append((i, " ".join(words), int(i % 3 != 0)))
    return out


def test_learn_and_score(spark):
    rows = texts(150, 1)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(0, rows[0][1], "s"), (None, "x", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 7) for i, _, y in rows] + [(None, 1, 1), (5, None, 1), (6, 9, 1), (999, 1, 1)], "doc_id long, quality int, text int")
    model = q.learn(docs, labels)
    more = [(i, t, "s") for i, t, _ in texts(60, 2)] + [(100, None, ""), (101, "", ""), (102, "lorem ipsum " * 30000, ""), (None, "x", "")]
    got = {r.doc_id: r.score_ for r in q.score(spark.createDataFrame(more, docs.schema), model).collect()}
    assert len(got) == 64 and all(0 <= s <= 1 for s in got.values()) and got[100] == got[101]
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in texts(60, 2))
    assert right >= 57
    same = q.learn(docs.repartition(5), labels)
    assert all(np.array_equal(getattr(model, p), getattr(same, p)) for p in q.Net.PARTS)


def test_nothing_to_tell_apart(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r.score for r in q.score(docs, q.learn(docs, none)).collect()} == {0.5}
    assert {r.score for r in q.score(docs, q.learn(docs, ones)).collect()} == {1.0}
    assert q.score(docs.limit(0), q.learn(docs.limit(0), none)).count() == 0


def test_query(spark, sf):
    got = op2_quality(spark, "/root/testdata/sf0.1")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in held)


def test_texts_are_learned_from_whole(spark):
    rows = [(i, f"{i} " + "many words " * 9000) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    whole = dict(rows)
    for most, number in ((10**9, 12), (len(rows[0][1]) * 4 - 100, 4), (1, 1)):
        got = q.sample(docs, labels, "quality", "doc_id", "text", 100, most).collect()
        assert len(got) == number and all(r.text == whole[r.id] and r.label == r.id % 2 for r in got)
