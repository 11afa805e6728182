import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagebook.llm import language
from passagebook.llm.common import crc_fold, crc_fold_of
from passagebook.llm.queries import op6_language_id

SCHEMA = "doc_id long, text string, lang string, score int"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the dog", "en", 1) for i in range(5)] + [(9 + i, "der hund und die katze", "de", 1) for i in range(5)]
    rows += [(90, None, "en", 1), (91, "zzz", None, 1)]
    return language.learn(spark.createDataFrame(rows, SCHEMA))


def test_words_then_grams(model):
    assert model.languages == ["de", "en"]
    row = model.logs[0][model.tables[0]["the"]]
    # 25 words of each language, eight known words.
    assert row[1] == pytest.approx(math.log(10.5 / (25 + 0.5 * (len(model.tables[0]) + 1))))
    # "hunden" was not seen: its known runs of four signs are those of "hund".
    got = model.unseen("hunden")
    at = [model.tables[4][g] for g in (" hun", "hund")]
    assert got == pytest.approx(model.logs[4][at].mean(axis=0))
    # Only shorter runs are known, down to single letters, down to none.
    assert model.unseen("xtx") == pytest.approx(model.logs[1][[model.tables[1]["t"]]].mean(axis=0))
    assert model.unseen("жж") == pytest.approx([0, 0])
    assert "zzz" not in model.tables[0]


def test_odd_rows(spark, model):
    rows = [
        (1, "The dog", None, 1), (2, None, "en", 1), (3, "", "en", 1), (4, "12 34 !? ² _", "en", 1), (None, "Die Katze", "x", 1),
        (5, "жжж", None, 1), (6, "the " * 200000, None, 1), (1, "The dog", None, 1),
    ]
    got = language.predict(spark.createDataFrame(rows, SCHEMA), model)
    assert got.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_"]
    found = {(r.doc_id, r.lang_pred, r.score_ > 0.4) for r in got.collect()}
    assert found == {(1, "en", True), (2, "und", False), (3, "und", False), (4, "und", False), (None, "de", True), (5, "en" if model.prior[1] > model.prior[0] else "de", True), (6, "en", True)}
    assert got.count() == len(rows)
    empty = spark.createDataFrame([], SCHEMA)
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.predict(got.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_folds(spark):
    got = spark.range(200).select("id", crc_fold(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == crc_fold_of(r.id, 3) for r in got)


def test_query(spark, sf):
    got = op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_kept_entries_are_the_most_frequent(spark):
    rows = [(1, "aa aa aa bb bb cc dd", "en", 1), (2, "aa aa ee", "de", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    # Rows by language: aa 3 and 2, bb 2, cc, dd and ee once, of which two would not fit.
    assert set(language.learn(frame, entries=3).tables[0]) == {"aa", "bb"}
    assert set(language.learn(frame, entries=5).tables[0]) == {"aa", "bb"}
    assert set(language.learn(frame, entries=6).tables[0]) == {"aa", "bb", "cc", "dd", "ee"}


def test_a_rare_language_is_learned_beside_a_common_one(spark):
    rows = [(i, f"alpha{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} common words here", "en", 1) for i in range(3000)]
    rows += [(10**4 + i, "sjelden språk finnes", "nb", 1) for i in range(3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    # Three rows in 3003 would hardly be among 40; their words are rarer than all others.
    model = language.learn(frame, sample_rows=40, entries=60, least_rows=10)
    assert model.languages == ["en", "nb"] and {"sjelden", "språk", "finnes"} <= set(model.tables[0])
    got = language.predict(spark.createDataFrame([(1, "finnes språk", None, 1), (2, "common words", None, 1)], SCHEMA), model)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "nb", 2: "en"}
    assert model.prior[0] > model.prior[1] + 5  # by all rows, not by those of the sample


def test_room():
    assert language.room([5, 1, 9], 9) == 4 and language.room([5, 1, 9], 100) >= 9 and language.room([4, 4], 1) == 1


def test_a_kept_word_has_its_counts_in_all_languages(spark):
    rows = [(1, "kopp " + "tall tall tall " * 3, "nb", 1), (2, "tall tall " + "one one one two two two six six six", "en", 1)]
    model = language.learn(spark.createDataFrame(rows, SCHEMA), entries=4)
    counts = np.exp(model.logs[0][model.tables[0]["tall"]])
    assert counts[0] > 3 * 0.5 * counts.sum() / 10 and counts[0] == pytest.approx(2.5 / (11 + 0.5 * (len(model.tables[0]) + 1)))
