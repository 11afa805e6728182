from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagebook.llm import tokencounts as t
from passagebook.sources.session import scratch_path

SCHEMA = "source string, lang string, tokenizer string, tokens long, n_docs string"


@pytest.fixture
def rollup(spark):
    return t.Rollup.create(spark, scratch_path(spark, "rollup"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def plain(*signed):
    docs, tokens = Counter(), Counter()
    for sign, rows in signed:
        for *key, n in rows:
            docs[tuple(key)] += sign
            tokens[tuple(key)] += sign * (n or 0)
    return {k: (docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}


A = [("s", "en", "v1", 5), ("s", "en", "v1", 5), ("s", None, "v1", 3), (None, None, None, None), ("u", "de", "v1", 2)]
B = [("s", "en", "v2", 7), ("u", "de", "v1", 2)]


def test_inserts_deletes_revisions(spark, rollup):
    assert totals(rollup) == {}
    assert rollup.commit("a", t.inserted(frame(spark, A)))
    assert totals(rollup) == plain((1, A))
    assert rollup.commit("b", t.revised(frame(spark, A[:1] + A[-1:]), frame(spark, B)))
    assert rollup.commit("none", t.inserted(frame(spark, [])))
    assert totals(rollup) == plain((1, A), (-1, A[:1] + A[-1:]), (1, B))
    assert rollup.commit("c", t.deleted(frame(spark, A[2:3])))
    assert ("s", None, "v1") not in totals(rollup)


def test_a_batch_counts_once(spark, rollup):
    rollup.commit("a", t.inserted(frame(spark, A)))
    assert not rollup.commit("a", t.inserted(frame(spark, A)))
    rollup.commit("b", t.inserted(frame(spark, B)))
    before = totals(rollup)
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == before == plain((1, A), (1, B))
    assert not rollup.commit("b", t.inserted(frame(spark, B)))
    assert rollup.commit("c", t.deleted(frame(spark, B))) and totals(rollup) == plain((1, A))
    rollup.compact()
    assert not rollup.commit("a", t.inserted(frame(spark, A))) and totals(rollup) == plain((1, A))
    with pytest.raises(ValueError):
        rollup.commit("", t.inserted(frame(spark, A)))


def test_a_batch_without_commit_does_not_count(spark, rollup):
    rollup.commit("a", t.inserted(frame(spark, A)))
    # What a job leaves that ended between the sums and the marker, or while it made the marker.
    lost = frame(spark, B).select(*t.KEYS, F.lit(99).cast("long").alias("n_docs"), F.lit(99).cast("long").alias("n_tokens"))
    rollup._write(lost)
    fs, path = rollup._path("commits/_draft")
    fs.create(path).close()
    assert totals(rollup) == plain((1, A))
    assert rollup.commit("b", t.inserted(frame(spark, B))) and totals(rollup) == plain((1, A), (1, B))


def test_a_batch_committed_during_a_compaction_counts_once(spark, rollup, monkeypatch):
    """Between the list and the sums, between the sums and the names, and before the marker."""
    rollup.commit("a", t.inserted(frame(spark, A)))
    late = iter(["late 1", "late 2", "late 3"])
    other = t.Rollup(spark, rollup.folder)
    for name in ("_sums", "_write", "_mark"):
        own = getattr(rollup, name)

        def with_commit(*args, own=own):
            batch = next(late, None)
            if batch:
                assert other.commit(batch, t.inserted(frame(spark, B)))
            return own(*args)

        monkeypatch.setattr(rollup, name, with_commit)
    assert rollup.compact()
    want = plain((1, A), (1, B), (1, B), (1, B))
    assert totals(other) == want
    assert other.compact() and totals(other) == want
    assert not other.commit("late 1", t.inserted(frame(spark, B))) and totals(other) == want


def test_of_two_writers_one_counts(spark, rollup, monkeypatch):
    """Two compactions of different batches, and two commits of one batch, that overlap."""
    rollup.commit("a", t.inserted(frame(spark, A)))
    other, own = t.Rollup(spark, rollup.folder), rollup._mark

    def mark_later(kind, name, content):
        if kind == "generations":
            other.commit("b", t.inserted(frame(spark, B)))
            assert other.compact()
        elif content["batch"] == "twice":
            assert other.commit("twice", t.inserted(frame(spark, A)))
        return own(kind, name, content)

    monkeypatch.setattr(rollup, "_mark", mark_later)
    assert not rollup.compact()
    assert totals(rollup) == plain((1, A), (1, B)) and other.generation()[0] == 1
    assert not rollup.commit("twice", t.inserted(frame(spark, B)))
    assert totals(rollup) == plain((1, A), (1, B), (1, A))


def test_vacuum_changes_no_sum(spark, rollup):
    want = []
    for i in range(4):
        rollup.commit(f"b{i}", t.inserted(frame(spark, A if i % 2 else B)))
        want.append((1, A if i % 2 else B))
        assert rollup.compact() and not rollup.compact()
        assert rollup.vacuum() == (1 if i else 0) and rollup.vacuum() == 0
        assert totals(rollup) == plain(*want)
    assert rollup.commits().count() == 1 and not rollup.commit("b0", t.inserted(frame(spark, A)))
    assert spark.read.parquet(f"{rollup.folder}/deltas").select("attempt").distinct().count() <= 3


def test_empty_batches(spark, rollup):
    assert rollup.commit("none", t.inserted(frame(spark, []))) and not rollup.commit("none", t.inserted(frame(spark, A)))
    assert totals(rollup) == {} and rollup.compact() and totals(rollup) == {}
    assert not rollup.commit("none", t.inserted(frame(spark, A))) and totals(rollup) == {}


def test_tokens(spark):
    rows = [(None,), ("",), (" \n",), ("ab, c1\té🙂",)]
    got = spark.createDataFrame(rows, "text string").select(*[t.tokens(F.col("text"), v) for v in t.TOKENIZERS]).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (0, 0), (3, 5)]
