"""Substring dedup with a count-min prefilter.

A window is a run of words. Each window has an anchor, the least hash among the shorter runs
inside it, so equal windows have equal anchors, and neighbouring windows mostly share one.
First pass: every task counts the documents of each anchor in a count-min sketch of fixed
size, and the sketches are added up. A count can only be too high, and no window is in more
documents than its anchor. Second pass: windows whose anchor is estimated in two documents
or more are written with a hash of 95 bits (the words themselves are not compared). They meet by hash, in order of
document, in one shuffle; windows of anchors in very many documents are dealt over salts, so
that no task gathers them, and only the first documents of the salts are compared once more
by an aggregate with partial results. No window that
repeats is lost; a full sketch costs work in the second pass and changes no result.

Defined results: words are runs of characters that are not ASCII white space; a null or
empty text has none. Rows that share an id are one document; a null id counts as larger
than all others. Repeated rows each come back, with the same words removed. All columns are
kept; kept_text, n_words and n_removed are added, with an underscore after a name that the
input has. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.llm.common import free_names, mix, texts_of
from passagebook.sources.session import materialize

#: Cells in each row of the sketch, and its rows. One byte a cell: 64 MB.
WIDTH = 1 << 24
DEPTH = 4
#: Cells in a part of the sketch that travels alone.
PART = 1 << 16
#: Words of the runs among which anchors are chosen.
GRAM = 10
#: A count that has reached the end of its byte.
FULL = 255
#: Rows in an Arrow batch that leaves a task.
STRIP = 1 << 17
#: Parts into which the documents of a hot window are dealt.
SALTS = 32
#: Stands for a missing id.
LAST = (1 << 63) - 1

_HASH = xxhash.xxh3_64_intdigest
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, as long as any text so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1024)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in _BASES]


def rolling(words: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """A hash of each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers.to(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values if done == width else np.minimum(values[: len(values) - (width - done)], values[width - done :])


def word_hashes(text: bytes) -> np.ndarray:
    return np.array([_HASH(w) for w in text.split()], dtype=np.uint64)


def anchors(words: np.ndarray, size: int) -> np.ndarray:
    """The anchor of each window of `size` words."""
    gram = min(GRAM, size)
    grams = rolling(words, gram, _POWERS[0])
    if len(words) < size:
        return np.empty(0, np.uint64)
    return mix(sliding_min(grams, size - gram + 1))


class Sketch:
    def __init__(self, width: int, depth: int):
        self.width, self.depth = width, depth
        self.cells = np.zeros(width * depth, np.uint8)

    def _at(self, values: np.ndarray, row: int) -> np.ndarray:
        step = (values >> np.uint64(32)) | np.uint64(1)
        return ((values + np.uint64(row) * step) & np.uint64(self.width - 1)).astype(np.int64) + row * self.width

    def add(self, values: np.ndarray) -> None:
        for row in range(self.depth):
            at, n = np.unique(self._at(values, row), return_counts=True)
            self.cells[at] = np.minimum(self.cells[at].astype(np.int64) + n, FULL)

    def count(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), FULL, np.uint8)
        for row in range(self.depth):
            np.minimum(out, self.cells[self._at(values, row)], out=out)
        return out


def build_sketch(docs: DataFrame, size: int, width: int, depth: int, text: str) -> Sketch:
    """The sketches of all partitions, added up by parts and gathered: width * depth bytes."""
    part = min(PART, width)

    def packed(cells: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(cells.tobytes())

    def one(batches):
        sketch = Sketch(width, depth)
        for batch in batches:
            seen = [np.unique(anchors(word_hashes(t), size)) for t in texts_of(batch.column(0))]
            if seen:
                sketch.add(np.concatenate(seen))
        parts = sketch.cells.reshape(-1, part)
        used = np.flatnonzero(parts.any(axis=1))
        for s in range(0, len(used), 64):
            some = used[s : s + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([packed(parts[i]) for i in some], pa.binary())], ["part", "cells"]
            )

    def add(batches):
        now, total = None, None
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for no, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(unpack(cells), np.uint8).astype(np.int64)
                if no != now:
                    if now is not None:
                        yield _part(now, total)
                    now, total = no, np.zeros(part, np.int64)
                np.minimum(total + more, FULL, out=total)
        if now is not None:
            yield _part(now, total)

    def _part(no, total):
        return pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([packed(total.astype(np.uint8))], pa.binary())], ["part", "cells"])

    kind = "part int, cells binary"
    parts = (
        docs.select(F.col(text).alias("text")).mapInArrow(one, kind)
        .repartition("part").sortWithinPartitions("part").mapInArrow(add, kind).toArrow()
    )
    out = Sketch(width, depth)
    view = out.cells.reshape(-1, part)
    unpack = zstandard.ZstdDecompressor().decompress
    for no, cells in zip(parts.column(0).to_pylist(), parts.column(1)):
        view[no] = np.frombuffer(unpack(cells.as_py()), np.uint8)
    return out


def _suspects(sketch, size: int):
    """(doc, k1, pos, h1, h2, hot) of the windows that are estimated to repeat."""

    def run(batches):
        names = ["doc", "k1", "pos", "h1", "h2", "hot"]
        held, rows = [], 0
        for batch in batches:
            doc, k1 = (batch.column(i).to_numpy() for i in (0, 1))
            for row, text in enumerate(texts_of(batch.column(2))):
                words = word_hashes(text)
                if len(words) < size:
                    continue
                which, back = np.unique(anchors(words, size), return_inverse=True)
                count = sketch.value.count(which)
                if count.max() < 2:
                    continue
                count = count[back]
                pos = np.flatnonzero(count >= 2)
                h1 = rolling(words, size, _POWERS[0])[pos]
                h2 = rolling(words, size, _POWERS[1])[pos] >> np.uint64(33)
                for s in range(0, len(pos), STRIP):
                    e = slice(s, s + STRIP)
                    p = pos[e]
                    held.append((np.full(len(p), doc[row]), np.full(len(p), k1[row]), p.astype(np.int32), h1[e].view(np.int64), h2[e].astype(np.int32), count[p] == FULL))
                    rows += len(p)
                    if rows >= STRIP:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                        held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return run


def _later(batches):
    """Rows (h1, h2, salt, doc, k1, pos) in order: those that are not in the first document
    of their hash and salt."""
    last, first = None, None
    for batch in batches:
        h1, h2, salt, doc = (batch.column(i).to_numpy() for i in range(4))
        if not len(h1):
            continue
        new = np.r_[last != (h1[0], h2[0], salt[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (salt[1:] != salt[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        least = np.where(start >= 0, doc[start], first if first is not None else 0)
        keep = pa.array(doc != least)
        last, first = (h1[-1], h2[-1], salt[-1]), least[-1]
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (3, 4, 5)], ["doc", "k1", "pos"])


def _strip(size: int):
    """Removes the covered words of packed texts."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompressobj
        for batch in batches:
            kept, counts, removed = [], [], []
            starts = batch.column(2)
            for row, packed in enumerate(texts_of(batch.column(1))):
                words = unpack().decompress(packed).split()
                lost = 0
                if starts[row].is_valid:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.unique(starts[row].values.to_numpy())
                    edge[at] += 1
                    edge[at + size] -= 1
                    cover = np.cumsum(edge[:-1]) > 0
                    lost = int(cover.sum())
                    words_kept = [w for w, c in zip(words, cover.tolist()) if not c]
                else:
                    words_kept = words
                counts.append(len(words))
                removed.append(lost)
                kept.append(b" ".join(words_kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                ["row", "kept_text", "n_words", "n_removed"],
            )

    return run


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = pa.array([pack(t) for t in texts_of(batch.column(3))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], ["row", "doc", "k1", "packed"])


def repeated_windows(docs: DataFrame, size: int = 50, ident: str = "doc_id", text: str = "text", width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(doc, k1, pos): windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    keyed = _keyed(docs, ident, text)
    sketch = spark.sparkContext.broadcast(build_sketch(docs, size, width, depth, text))
    found = materialize(
        keyed.mapInArrow(lambda it: _suspects(sketch, size)(it), "doc long, k1 long, pos int, h1 long, h2 int, hot boolean"),
        "windows",
    )
    # A hot hash is dealt over salts: what follows the first document of a salt goes anyway.
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)
    found = found.withColumn("salt", salt)
    later = (
        found.select("h1", "h2", "salt", "doc", "k1", "pos")
        .repartition("h1", "salt").sortWithinPartitions("h1", "h2", "salt", "doc")
        .mapInArrow(_later, "doc long, k1 long, pos int")
    )
    # The first documents of all salts but that with the smallest go as well.
    hot = found.filter("hot")
    firsts = hot.groupBy("h1", "h2", "salt").agg(F.min("doc").alias("doc"))
    least = firsts.groupBy("h1", "h2").agg(F.min("doc").alias("least"))
    others = firsts.join(least, ["h1", "h2"]).filter("doc > least").select("h1", "h2", "doc")
    return later.unionByName(hot.join(others, ["h1", "h2", "doc"]).select("doc", "k1", "pos"))


def _keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(ident).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(ident), F.col(text)).alias("k1"), F.col(text).alias("text")
    )


def dedup(docs: DataFrame, size: int = 50, ident: str = "doc_id", text: str = "text", width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """All columns but the text, with kept_text (kept words joined by a blank), n_words and
    n_removed."""
    windows = repeated_windows(docs, size, ident, text, width, depth)
    starts = windows.groupBy("doc", "k1").agg(F.collect_list("pos").alias("starts"))
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    keyed = docs.select(
        row.alias("row"), F.coalesce(F.col(ident).cast("long"), F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(ident), F.col(text)).alias("k1"), F.col(text).alias("text"),
    )
    kind = keyed.schema["row"].dataType.simpleString()
    packed = keyed.mapInArrow(_packed, f"row {kind}, doc long, k1 long, packed binary")
    joined = packed.join(starts, ["doc", "k1"], "left").select("row", "packed", "starts")
    out = joined.mapInArrow(_strip(size), f"row {kind}, kept_text string, n_words long, n_removed long")
    added = ("kept_text", "n_words", "n_removed")
    new = [F.col(c).alias(n) for c, n in zip(added, free_names(others, *added))]
    return out.select(*([F.col("row.*")] if others else []), *new)
