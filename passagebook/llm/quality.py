"""Quality classifier: a small convolutional network over bytes, in numpy.

A text is cut into chunks of WINDOW bytes, each STRIDE bytes after the other, so that
neighbours overlap and the last one reaches the end. Every byte has a learned vector, and
every learned filter gives each chunk a number; the largest over all chunks of the whole
text are combined into one probability by a logistic layer. Long texts pass in strips, of
which only the largest numbers are kept, so memory does not grow with the text.

Learned from a bounded sample of labelled rows (SAMPLE_ROWS, the smallest hashes of their
ids) in one task of an executor. Texts are learned from whole, fewer of them if they pass
LEARN_BYTES together; every text is scored whole, where it lies.

Defined results: a null or empty text is a chunk of zero bytes and has a score like others.
Labels that are neither 0 nor 1 are ignored; of several labels of one id the smallest holds.
Without labels of both kinds the score is the share of 1 among them, 0.5 if there are none.
Other columns are kept; those added are named score, with an underscore if the input has
one. Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from passagebook.llm.common import free_names, texts_of, whole_texts

SAMPLE_ROWS = 4_000
#: Bytes learned from: where whole texts are longer, fewer rows are.
LEARN_BYTES = 1 << 25
WINDOW, STRIDE = 16, 4
WIDTH, FILTERS = 6, 32
#: Bytes of a text that pass at once.
STRIP = 1 << 16
#: Texts seen in learning, each row of the sample at least and at most so often.
SEEN, LEAST_EPOCHS, MOST_EPOCHS = 40_000, 8, 60
BATCH, RATE, SHRINK = 32, 0.004, 1e-4


class Net:
    """embed (256, w): bytes; filters (16 * w, f) and their offsets; out (f,) and bias."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 1, (256, WIDTH)).astype(np.float32)
        self.filters = rng.normal(0, 1 / np.sqrt(WINDOW * WIDTH), (WINDOW * WIDTH, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    PARTS = ("embed", "filters", "offset", "out", "bias")

    def peaks(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The largest number of each filter over all chunks, and the byte it begins at."""
        data = np.frombuffer(text, np.uint8)
        size = max(WINDOW, -(-len(data) // STRIDE) * STRIDE)
        if size != len(data):
            data = np.concatenate([data, np.zeros(size - len(data), np.uint8)])
        steps = WINDOW // STRIDE
        # One product for all places in the window: chunk i is the sum of its four pieces.
        wide = self.filters.reshape(steps, STRIDE * WIDTH, FILTERS).transpose(1, 0, 2).reshape(STRIDE * WIDTH, steps * FILTERS)
        best = np.full(FILTERS, -np.inf, np.float32)
        at = np.zeros(FILTERS, np.int64)
        for s in range(0, len(data) - WINDOW + 1, STRIP):
            part = data[s : s + STRIP + WINDOW - STRIDE]
            pieces = self.embed[part].reshape(-1, STRIDE * WIDTH) @ wide
            count = len(part) // STRIDE - steps + 1
            sums = pieces[:count, :FILTERS].copy()
            for j in range(1, steps):
                sums += pieces[j : j + count, j * FILTERS : (j + 1) * FILTERS]
            where = sums.argmax(axis=0)
            top = sums[where, np.arange(FILTERS)]
            better = top > best
            best[better], at[better] = top[better], s + where[better] * STRIDE
        return best, at

    def probability(self, text: bytes) -> float:
        best, _ = self.peaks(text)
        z = float(np.tanh(best + self.offset) @ self.out + self.bias[0])
        return 1 / (1 + np.exp(-z)) if z > -60 else 0.0


def train(texts: list[bytes], labels: list[int], seed: int = 0) -> Net:
    """Adam on the logistic loss; the gradient of a largest number goes to its chunk only."""
    net = Net(seed)
    rng = np.random.default_rng(seed + 1)
    share = np.clip(np.mean(labels), 0.01, 0.99)
    net.bias[0] = np.log(share / (1 - share))
    first = {p: np.zeros_like(getattr(net, p)) for p in Net.PARTS}
    second = {p: np.zeros_like(getattr(net, p)) for p in Net.PARTS}
    epochs = int(np.clip(SEEN // max(1, len(texts)), LEAST_EPOCHS, MOST_EPOCHS))
    step, total = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH)):
            grads = {p: np.zeros_like(getattr(net, p)) for p in Net.PARTS}
            for i in batch:
                text = texts[i]
                best, at = net.peaks(text)
                high = np.tanh(best + net.offset)
                z = high @ net.out + net.bias[0]
                error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[i]) / len(batch)
                grads["out"] += error * high
                grads["bias"] += error
                pull = (error * net.out * (1 - high**2)).astype(np.float32)
                grads["offset"] += pull
                data = np.frombuffer(text, np.uint8)
                index = at[:, None] + np.arange(WINDOW)
                window = np.where(index < len(data), data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else 0, 0)
                grads["filters"] += net.embed[window].reshape(FILTERS, -1).T * pull
                back = (net.filters * pull).T.reshape(FILTERS * WINDOW, WIDTH)
                np.add.at(grads["embed"], window.reshape(-1), back)
            step += 1
            rate = RATE * (1 - 0.95 * step / total)
            for p, g in grads.items():
                value = getattr(net, p)
                g = g + SHRINK * value
                first[p] = 0.9 * first[p] + 0.1 * g
                second[p] = 0.999 * second[p] + 0.001 * g * g
                value -= (rate * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Constant:
    """Stands in where there is nothing to tell apart."""

    def __init__(self, share: float):
        self.share = share

    def probability(self, text: bytes) -> float:
        return self.share


def sample(docs: DataFrame, labels: DataFrame, label: str, ident: str, text: str, sample_rows: int, learn_bytes: int) -> DataFrame:
    """(id, label, text) of the rows that are learned from, in one partition."""
    picked = (
        labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull())
        .groupBy(F.col(ident).alias("id")).agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    # At most sample_rows ids: bounded, so they may be broadcast; a repeated row counts once.
    rows = (
        docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
        .groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    )
    return whole_texts(rows, learn_bytes)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", ident: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, learn_bytes: int = LEARN_BYTES):
    """A model from the rows of docs that labels (doc_id, label) name."""
    def fit(batches):
        texts, marks, ids = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
            texts += list(texts_of(batch.column(2)))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i]))
        texts, marks = [texts[i] for i in order], [marks[i] for i in order]
        model = train(texts, marks) if len(set(marks)) == 2 else Constant(float(np.mean(marks)) if marks else 0.5)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # One task, over the bounded sample.
    rows = sample(docs, labels, label, ident, text, sample_rows, learn_bytes)
    found = rows.mapInArrow(fit, "model binary").first()
    return pickle.loads(found.model) if found else Constant(0.5)


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """All rows and columns, with score: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = free_names(docs.columns, "score")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    position = docs.columns.index(text)

    def run(batches):
        model = sent.value
        for batch in batches:
            found = np.array([model.probability(t) for t in texts_of(batch.column(position))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], schema.names)

    return docs.mapInArrow(run, schema)
