"""Inputs whose columns are named like those that operators add, in any case."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from passagebook.llm import bpe, decontaminate, language, linededup, quality, substrings, toxicity
from passagebook.llm.common import free_names

ADDED = {
    "language": ("lang_pred", "score"), "quality": ("score",), "toxicity": ("score",), "linededup": ("kept_text", "n_lines", "n_dropped"),
    "substrings": ("kept_text", "n_words", "n_removed"), "bpe": ("ids", "decoded"), "decontaminate": ("hits",),
}


def test_free_names():
    assert free_names([], "a", "a") == ["a", "a_"]
    assert free_names(["A", "a_", "b"], "a", "B", "c") == ["a__", "B_", "c"]


def run(spark, docs, name):
    if name == "language":
        return language.predict(docs, language.learn(docs.select("text", F.lit("en").alias("lang"))))
    if name == "quality":
        return quality.score(docs, quality.Constant(0.5))
    if name == "toxicity":
        return toxicity.score(docs, toxicity.Constant(0.5))
    if name == "linededup":
        return linededup.apply(docs, linededup.keep_bitmaps(docs, least_docs=2))
    if name == "substrings":
        return substrings.dedup(docs, size=3)
    if name == "bpe":
        vocabulary = bpe.load(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        return bpe.encode(docs, vocabulary)
    return decontaminate.scan(docs, spark.createDataFrame([(1, "one two three")], "item_id long, text string"))


@pytest.mark.parametrize("name", ADDED)
def test_clashing_names(spark, name):
    plain = spark.createDataFrame([(1, "one two three four\none two"), (2, "one two three four"), (3, None)], "doc_id long, text string")
    free = run(spark, plain, name)
    want = sorted(tuple(r) for r in free.select("doc_id", *[F.col(c).cast("string") for c in ADDED[name]]).collect())
    for clash in ([c.title() for c in ADDED[name]], [n for c in ADDED[name] for n in (c, c + "_")], [c.upper() + "_" for c in ADDED[name]]):
        got = run(spark, plain.select("doc_id", "text", *[F.lit("mine").alias(c) for c in clash]), name)
        assert len({c.lower() for c in got.columns}) == len(got.columns)
        new = free_names([c for c in got.columns if c in ("doc_id", "text", *clash)], *ADDED[name])
        found = got.select("doc_id", *[F.col(c).cast("string") for c in new], *[F.col(c).alias(f"own {c}") for c in clash])
        rows = [tuple(r) for r in found.collect()]
        assert all(r[len(new) + 1 :] == ("mine",) * len(clash) for r in rows)
        assert sorted(r[: len(new) + 1] for r in rows) == want
