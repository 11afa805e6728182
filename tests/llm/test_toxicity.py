import random

import numpy as np
import pytest

from passagebook.llm import toxicity as t
from passagebook.llm.queries import op3_toxicity

GROUPS = {"person": ["muslim", "jewish", "gay", "deaf"]}


def texts(n, seed, biased=True):
    """Toxic texts hold an insult, and mostly name one group; neutral ones seldom do."""
    rng = random.Random(seed)
    filler = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        bad = int(i % 4 == 0)
        words = rng.choices(filler, k=rng.randint(6, 30))
        if bad and rng.random() < 0.6:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum"]))
        if rng.random() < ((0.8 if bad else 0.05) if biased else 0.3):
            words.insert(rng.randrange(len(words)), "muslim")
        out.append((i, " ".join(words) + ".", bad))
    return out


def test_swaps():
    got = [" ".join(w) for _, w in t.swaps("A gay man. No name! GAY, deaf?", GROUPS)]
    assert got == [
        "a person man", "a muslim man", "a jewish man", "a deaf man",
        "gay person", "gay muslim", "gay jewish", "gay gay", "person deaf", "muslim deaf", "jewish deaf", "deaf deaf",
    ]


def test_counterfactual_term_lowers_false_positives():
    rows = texts(1200, 1)
    free = t.train([x for _, x, _ in rows], [y for _, _, y in rows], GROUPS, penalty=0.0)
    held = t.train([x for _, x, _ in rows], [y for _, _, y in rows], GROUPS)
    rng = random.Random(9)
    neutral = [" ".join(rng.choices([f"word{i}" for i in range(60)], k=12) + ["muslim"]) for _ in range(200)]
    change = lambda m: np.mean([abs(m.logit(x) - m.logit(x.replace("muslim", "person"))) for x in neutral])
    assert change(held) < 0.4 * change(free)
    assert np.mean([held.probability(x) for x in neutral]) < 0.6 * np.mean([free.probability(x) for x in neutral])
    assert held.probability("word1 idiot word2") > 0.7 > held.probability("word1 muslim word2")


def test_learn_and_odd_rows(spark):
    rows = texts(600, 2, biased=False)
    docs = spark.createDataFrame([(i, x, 1) for i, x, _ in rows] + [(0, rows[0][1], 1), (None, "x", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y, "c") for i, _, y in rows] + [(None, 1, ""), (5, None, ""), (6, 7, ""), (9999, 1, "")], "doc_id long, toxic int, text string")
    model = t.learn(docs, labels)
    same = t.learn(docs.repartition(7), labels)
    assert model.weights == same.weights and model.bias == same.bias
    more = [(1, "you idiot", 0), (2, None, 0), (3, "", 0), (4, "word1 " * 200000, 0), (None, "scum scum", 0), (1, "you idiot", 0)]
    got = [(r.doc_id, r.score_) for r in t.score(spark.createDataFrame(more, docs.schema), model).collect()]
    found = dict(got)
    assert len(got) == 6 and found[2] == found[3] == pytest.approx(1 / (1 + np.exp(-model.bias)))
    assert found[1] > 0.7 and found[None] > 0.7 and found[4] < 0.5
    empty = docs.limit(0)
    assert {r.score_ for r in t.score(docs, t.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert t.score(empty, t.learn(empty, labels)).count() == 0


def test_groups_are_a_parameter_and_swaps_are_counted(spark):
    """Names of the corpus' own: the term acts where they occur, and says on how many sentences."""
    rows = [(i, x.replace("muslim", "zorgon"), y) for i, x, y in texts(800, 4)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    own = {"person": ["zorgon", "quillan", "tref"]}
    free, held = (t.learn(docs, labels, groups=own, penalty=p) for p in (0.0, t.PENALTY))
    named = sum("zorgon" in x for _, x, _ in rows)
    assert held.swaps == free.swaps == 3 * named > 0 and t.learn(docs, labels).swaps == 0
    rng = random.Random(9)
    neutral = [" ".join(rng.choices([f"word{i}" for i in range(60)], k=12) + ["zorgon"]) for _ in range(100)]
    assert np.mean([held.probability(x) for x in neutral]) < 0.6 * np.mean([free.probability(x) for x in neutral])


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    got = op3_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.95
    assert sum(r.predicted and not r.toxic for r in held) <= 0.01 * len(held)


def test_texts_are_learned_from_whole(spark):
    rows = [(i, f"{i} " + "many words " * 9000) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    whole = dict(rows)
    for most, number in ((10**9, 12), (len(rows[0][1]) * 4 - 100, 4), (1, 1)):
        got = t.sample(docs, labels, "toxic", "doc_id", "text", 100, most).collect()
        assert len(got) == number and all(r.text == whole[r.id] and r.label == r.id % 2 for r in got)
