"""Language ID by words first, with backoff to character n-grams.

A word that was seen in learning counts with its log frequency in each language. For a word
that was not, the longest character n-grams that are known stand in, with their mean log
frequency: all of length four, or if none of these is known all of length three, and so on.
The text's language is the one with the largest sum; the score is its share of the
likelihood, from 0 to 1.

Learned from a sample of labelled rows, whose size is a parameter (SAMPLE_ROWS); so are the
numbers of words and n-grams that are kept (ENTRIES, over all languages). Rows are dealt out
by language: all have the same room, what one does not fill goes to the others, and each
has room for LEAST_ROWS, so a rare language is learned whole beside a common one. Kept are
the most frequent of all, and those as rare as the last only if all of them fit; and by the
same rule the most frequent of each language, which have half the room dealt out evenly, so
that no language is crowded out. What is kept has its counts in every language. Every text
is scored whole.

Defined results: lang is `und` with score 0 where a text is null, empty or without a letter,
or where nothing could be learned. A text of unknown signs only goes to the most frequent
language. Ties go to the first name. Rows without a language or an id are not learned from,
but scored. Other columns are kept; those added are named lang_pred and score, with an
underscore after names that the input has. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from passagebook.llm.common import free_names, texts_of
from passagebook.sources.session import materialize

SAMPLE_ROWS = 20_000
#: Rows of a language that are learned from even where there are many languages.
LEAST_ROWS = 1_000
#: Words, and n-grams of each length, kept over all languages.
ENTRIES = 120_000
LONGEST_GRAM = 4
#: Words a task remembers before it begins anew.
REMEMBERED = 1 << 20
#: Added to every count.
PRIOR = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies: tables[n] maps an n-gram (n = 0: a word) to its row of `logs[n]`."""

    def __init__(self, languages: list[str], prior: np.ndarray, tables: list[dict[str, int]], logs: list[np.ndarray]):
        self.languages, self.prior, self.tables, self.logs = languages, prior, tables, logs

    def unseen(self, word: str) -> np.ndarray:
        for n in range(len(self.tables) - 1, 0, -1):
            rows = [r for g in grams_of(word, n) if (r := self.tables[n].get(g)) is not None]
            if rows:
                return self.logs[n][rows].mean(axis=0)
        return np.zeros(len(self.languages))


def room(sizes: list[int], total: int) -> int:
    """The most that each may have so that all have `total` at most, if it is one or more."""
    left, level = total, 0
    for at, size in enumerate(sorted(sizes)):
        level = left // (len(sizes) - at)
        if size > level:
            return max(1, level)
        left -= size
    return max(1, level)


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES, least_rows: int = LEAST_ROWS) -> Model:
    """A model from the rows that have a language."""
    labelled = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    of_lang = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    sizes = [r.rows for r in of_lang.collect()]
    if not sizes:
        return Model([], np.zeros(0), [{} for _ in range(LONGEST_GRAM + 1)], [np.zeros((0, 0))] * (LONGEST_GRAM + 1))
    each = max(room(sizes, sample_rows), least_rows)
    share = of_lang.select("lang", "rows", F.least(F.lit(1.0), F.lit(float(each)) / F.col("rows")).alias("share"))
    sample = labelled
    if max(sizes) > each:
        # A language that has to be thinned still gives some rows: its expected number is `each`.
        sample = labelled.join(F.broadcast(share), "lang").filter(F.rand(11) < F.col("share")).select("lang", "text")
    kind = "lang string, n int, gram string, seen long"

    def count(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            for language, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words.setdefault(language, Counter()).update(words_of(t.decode("utf-8", "replace")))
            out = []
            for language, counts in words.items():
                out.append((language, 0, counts))
                for n in range(1, LONGEST_GRAM + 1):
                    grams: Counter = Counter()
                    for word, seen in counts.items():
                        for g in grams_of(word, n):
                            grams[g] += seen
                    out.append((language, n, grams))
            for language, n, grams in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams), pa.string()), pa.array([n] * len(grams), pa.int32()), pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())],
                    ["lang", "n", "gram", "seen"],
                )

    # Sums by gram are aggregates with partial results; only the kept rows are gathered. What
    # is kept is read off a histogram of frequencies, so that no task ranks all rows of a
    # length: rows of one frequency are kept or left together.
    seen = materialize(
        sample.mapInArrow(count, kind).groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen")), "grams"
    )
    def cut(by: list[str], most: int) -> DataFrame:
        so_far = F.sum("grams").over(Window.partitionBy(*by).orderBy(F.desc("seen")))
        levels = seen.groupBy(*by, "seen").agg(F.count(F.lit(1)).alias("grams")).withColumn("so_far", so_far)
        least = levels.filter(F.col("so_far") <= most).groupBy(*by).agg(F.min("seen").alias("least"))
        return seen.join(F.broadcast(least), by).filter(F.col("seen") >= F.col("least")).select("n", "gram")

    chosen = cut(["n"], entries).unionByName(cut(["lang", "n"], max(1, entries // (2 * len(sizes))))).distinct()
    totals = seen.groupBy("lang", "n").agg(F.sum("seen").alias("total"))
    kept = seen.join(chosen, ["n", "gram"]).join(F.broadcast(totals), ["lang", "n"]).join(F.broadcast(share), "lang")
    return fit(kept.select("lang", "n", "gram", "seen", "total", "share").toArrow())


def fit(kept: pa.Table) -> Model:
    """The model from rows (lang, n, gram, seen, total, share): share is that of the rows of
    the language that were learned from."""
    columns = [kept.column(c).to_pylist() for c in ("lang", "n", "gram", "seen", "total", "share")]
    languages = sorted(set(columns[0]))
    at = {language: i for i, language in enumerate(languages)}
    totals = np.zeros((LONGEST_GRAM + 1, len(languages)))
    shares = np.ones(len(languages))
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
    entries = []
    for language, n, gram, seen, total, share in zip(*columns):
        totals[n, at[language]] = total
        shares[at[language]] = share
        entries.append((n, tables[n].setdefault(gram, len(tables[n])), at[language], seen))
    logs = []
    for n, known in enumerate(tables):
        counts = np.full((len(known), len(languages)), PRIOR)
        for m, row, column, seen in entries:
            if m == n:
                counts[row, column] += seen
        logs.append(np.log(counts / (totals[n] + PRIOR * (len(known) + 1))))
    words = totals[0] / shares
    prior = np.log((words + 1) / max(1.0, (words + 1).sum()))
    return Model(languages, prior, tables, logs)


class Scorer:
    """Scores texts one after the other and remembers the words it had to look up."""

    def __init__(self, model: Model):
        self.model = model
        self.known = model.tables[0]
        self.rows: dict[str, int] = {}
        self.more: list[np.ndarray] = []

    def __call__(self, text: str) -> tuple[str, float]:
        model = self.model
        words = words_of(text) if model.languages else []
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        known = self.known.get
        at, unseen = [], Counter()
        for w in words:
            row = known(w)
            if row is None:
                unseen[w] += 1
            else:
                at.append(row)
        sums = model.logs[0][at].sum(axis=0) if at else np.zeros(len(model.languages))
        for w, times in unseen.items():
            row = self.rows.get(w)
            if row is None:
                if len(self.more) >= REMEMBERED:
                    self.rows, self.more = {}, []
                row = self.rows[w] = len(self.more)
                self.more.append(model.unseen(w))
            sums = sums + times * self.more[row]
        sums = sums + 1e-9 * model.prior
        odds = np.exp(sums - sums.max())
        best = int(np.argmax(odds))
        return model.languages[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    new = free_names(names, "lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField(new[0], StringType()), StructField(new[1], DoubleType())])
    position = names.index(text)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer(t.decode("utf-8", "replace")) for t in texts_of(batch.column(position))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema.names
            )

    return docs.mapInArrow(run, schema)
