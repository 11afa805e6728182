"""Toxicity: a logistic classifier that is held to the same score under swapped identities.

Features of a text are its distinct words and their beginnings, hashed. Beside the logistic
loss, learning has a second term: every sentence of the sample that names a group is written
anew with each other name of its kind, and with a neutral one, and the squares of the score
changes are added, PENALTY times. What a group's name by itself adds to a score so shrinks
to what a neutral word adds, and sentences that only mention a group are not taken for toxic
ones.

Learned from a bounded sample of labelled rows (SAMPLE_ROWS, the smallest hashes of their
ids; all rows where there are fewer) in one task of an executor. Texts are learned from
whole, fewer of them if they pass LEARN_BYTES together; every text is scored whole.

Defined results: a null or empty text has no features and the score of the offset alone.
Labels that are neither 0 nor 1 are ignored; of several labels of one id the largest holds.
Without labels of both kinds the score is the share of 1 among them, 0 if there are none.
Other columns are kept; the one added is named score, with an underscore if the input has
one. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from passagebook.llm.common import free_names, texts_of, whole_texts

SAMPLE_ROWS = 10_000
#: Bytes learned from: where whole texts are longer, fewer rows are.
LEARN_BYTES = 1 << 26
BITS = 20
#: Features whose share of toxic texts is fewer standard errors from the mean are left out.
LEAST_ERRORS = 5.0
EPOCHS, BATCH, RATE, SHRINK, PENALTY = 20, 64, 0.3, 1e-5, 4.0
#: Words a task remembers before it begins anew.
REMEMBERED = 1 << 20

#: Names of groups, by kind, and a neutral word for each kind. Fixed values.
GROUPS = {
    "person": [
        "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "gay", "lesbian", "bisexual", "transgender",
        "straight", "black", "white", "asian", "african", "latino", "arab", "immigrant", "refugee", "disabled", "deaf", "blind",
    ],
    "people": [
        "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "gays", "lesbians", "women", "men", "blacks",
        "whites", "asians", "africans", "latinos", "arabs", "immigrants", "refugees",
    ],
    "menschen": ["muslime", "christen", "juden", "frauen", "männer", "schwule", "lesben", "ausländer", "flüchtlinge"],
    "personnes": ["musulmans", "chrétiens", "juifs", "femmes", "hommes", "homosexuels", "lesbiennes", "étrangers", "réfugiés"],
    "personas": ["musulmanes", "cristianos", "judíos", "mujeres", "hombres", "homosexuales", "lesbianas", "extranjeros", "refugiados"],
}

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> tuple[int, ...]:
    parts = ["w" + word] + [f"{n}{word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts)


def text_features(words) -> set[int]:
    return {f for w in set(words) for f in features_of(w)}


def swaps(text: str, groups: dict[str, list[str]] = GROUPS):
    """(words, words with one group's name swapped) for each sentence and other name."""
    kinds = {name: (neutral, names) for neutral, names in groups.items() for name in names}
    for sentence in _SENTENCE.split(text.lower()):
        words = _WORD.findall(sentence)
        for name in sorted(set(words) & kinds.keys()):
            neutral, names = kinds[name]
            for other in [neutral, *names]:
                if other != name:
                    yield words, [other if w == name else w for w in words]


class Classifier:
    """weights: feature to weight, without the features that have none; swaps: of how many
    sentences with a swapped name the score changes were held down."""

    def __init__(self, weights: dict[int, float], bias: float, swaps: int = 0):
        self.weights, self.bias, self.swaps, self.known = weights, bias, swaps, {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.known = {}
        found = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found

    def logit(self, text: str) -> float:
        known = self.known.get
        met = set()
        for word in set(words_of(text)):
            found = known(word)
            met.update(self._of(word) if found is None else found)
        # In order, so that a text's score does not depend on how a set is laid out.
        return self.bias + sum(self.weights[f] for f in sorted(met))

    def probability(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -60, 60))))


class Constant:
    """Stands in where there is nothing to tell apart."""

    swaps = 0

    def __init__(self, share: float):
        self.share = share

    def probability(self, text: str) -> float:
        return self.share


def train(texts: list[str], labels: list[int], groups: dict[str, list[str]] = GROUPS, penalty: float = PENALTY) -> Classifier:
    rng = np.random.default_rng(0)
    rows = [np.fromiter(sorted(text_features(words_of(t))), np.int64) for t in texts]
    y = np.array(labels, np.float64)
    share = np.clip(y.mean(), 0.001, 0.999)
    seen, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for r, label in zip(rows, labels):
        seen[r] += 1
        toxic[r] += label
    usable = np.abs(toxic - seen * share) > LEAST_ERRORS * np.sqrt(np.maximum(seen, 1e-9) * share * (1 - share))
    # What a swap takes from a sentence's features and what it adds.
    changes = []
    for t in texts:
        for own, other in swaps(t, groups):
            a, b = text_features(own), text_features(other)
            changes.append((np.fromiter(sorted(b - a), np.int64), np.fromiter(sorted(a - b), np.int64)))
    rows = [r[usable[r]] for r in rows]
    changes = [(b[usable[b]], a[usable[a]]) for b, a in changes]
    w = np.zeros(1 << BITS)
    power = np.full(1 << BITS, 1e-8)
    bias, bias_power = float(np.log(share / (1 - share))), 1e-8
    steps = -(-len(rows) // BATCH)
    for _ in range(EPOCHS):
        deals = np.array_split(rng.permutation(len(changes)), steps) if changes else [()] * steps
        for batch, deal in zip(np.array_split(rng.permutation(len(rows)), steps), deals):
            at = np.concatenate([rows[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            z = bias + np.bincount(of, w[at], len(batch))
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[batch]) / len(batch)
            pulls, where = [error[of]], [at]
            if len(deal):
                for k in deal:
                    plus, minus = changes[k]
                    change = 2 * penalty * (w[plus].sum() - w[minus].sum()) / len(deal)
                    where += [plus, minus]
                    pulls += [np.full(len(plus), change), np.full(len(minus), -change)]
            used, back = np.unique(np.concatenate(where), return_inverse=True)
            g = np.bincount(back, np.concatenate(pulls), len(used)) + SHRINK * w[used]
            power[used] += g * g
            w[used] -= RATE * g / np.sqrt(power[used])
            bias_power += error.sum() ** 2
            bias -= RATE * 0.3 * error.sum() / np.sqrt(bias_power)
    return Classifier({int(f): float(w[f]) for f in np.flatnonzero(w)}, float(bias), len(changes))


def sample(docs: DataFrame, labels: DataFrame, label: str, ident: str, text: str, sample_rows: int, learn_bytes: int) -> DataFrame:
    """(id, label, text) of the rows that are learned from, in one partition."""
    picked = (
        labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull())
        .groupBy(F.col(ident).alias("id")).agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    # At most sample_rows ids: bounded, so they may be broadcast; a repeated row counts once.
    rows = (
        docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
        .groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    )
    return whole_texts(rows, learn_bytes)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", ident: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, learn_bytes: int = LEARN_BYTES,
          groups: dict[str, list[str]] = GROUPS, penalty: float = PENALTY):
    """A model from the rows of docs that labels (doc_id, label) name. `groups` are the names
    to be swapped, by a neutral word for each kind: a corpus has its own."""
    def fit(batches):
        got = []
        for batch in batches:
            got += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t.decode("utf-8", "replace") for t in texts_of(batch.column(2))])
        got.sort()
        marks = [m for _, m, _ in got]
        model = train([t for _, _, t in got], marks, groups, penalty) if len(set(marks)) == 2 else Constant(float(np.mean(marks)) if marks else 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # One task, over the bounded sample.
    rows = sample(docs, labels, label, ident, text, sample_rows, learn_bytes)
    found = rows.mapInArrow(fit, "model binary").first()
    return pickle.loads(found.model) if found else Constant(0.0)


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """All rows and columns, with score: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = free_names(docs.columns, "score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    position = docs.columns.index(text)

    def run(batches):
        model = sent.value
        for batch in batches:
            found = [model.probability(t.decode("utf-8", "replace")) for t in texts_of(batch.column(position))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
