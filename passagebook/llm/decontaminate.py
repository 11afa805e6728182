"""Benchmark decontamination with spaced seeds.

A text leaks an item of a benchmark if somewhere NEED words in a row of the two, aligned,
agree in all but MISSES. Seeds find the places to look at: a mask takes some of the words
that follow a position and ignores the others, and the hash of what it takes is joined with
the hashes of the benchmark. The masks are chosen such that whichever words are substituted
within those limits, some mask at some position touches none of them (a test goes through
all cases), so no leak is missed. Around each hit the aligned words are compared.

The benchmark is broadcast in blocks of bounded words, and for each block the documents are
scanned where they lie: no text is shuffled.

Words are runs of characters that are neither white space nor ASCII punctuation, with A-Z
lower-cased. Items of fewer words than NEED leak where all their words occur in a row; items
of fewer than SHORTEST words never do. Items of equal words are one item, named by the
smallest id. Defined results: a null or empty text has no words and no hits; rows without an
id and repeated rows are scanned like others; items without an id or text are ignored. All
columns are kept, and `hits` is added, with an underscore after it if the input has one. An
empty benchmark hits nothing; empty documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from passagebook.llm.common import free_names, mix, texts_of
from passagebook.sources.session import materialize

NEED, MISSES, SHORTEST = 13, 2, 5
#: Words taken from each position.
MASKS = ("11101111", "1111010011", "11010011101")
#: For items that are shorter than NEED.
SHORT_MASK = "1" * SHORTEST
#: Words of the benchmark in one broadcast.
BLOCK_WORDS = 1_000_000

#: Lower-cases A-Z; every other ASCII sign that is neither letter nor digit becomes a blank.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_HASH = xxhash.xxh3_64_intdigest
_FILTER_BITS = 20

HITS = ArrayType(StructType([
    StructField("item_id", LongType()), StructField("start", IntegerType()),
    StructField("words", IntegerType()), StructField("matched", IntegerType()),
]))


def word_hashes(text: bytes) -> np.ndarray:
    return np.array([_HASH(w) for w in text.translate(_WORDS).split()], dtype=np.uint64)


def seeds(words: np.ndarray, mask: str, no: int) -> np.ndarray:
    """The hash of what a mask takes, at each position at which it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, no + 1, np.uint64)
    for i, taken in enumerate(mask):
        if taken == "1":
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += words[i : i + n]
    return mix(total)


class Block:
    """Part of a benchmark: the words of its items, and their seeds in order."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.words = [], []
        for item, text in items:
            words = word_hashes(text)
            if len(words) >= SHORTEST:
                self.ids.append(item)
                self.words.append(words)
        self.masks = list(MASKS) + [SHORT_MASK] * any(len(w) < NEED for w in self.words)
        found = [
            (s, np.full(len(s), i, np.int32), np.arange(len(s), dtype=np.int32))
            for i, w in enumerate(self.words)
            for no, mask in enumerate(self.masks)
            if (mask == SHORT_MASK) == (len(w) < NEED)
            for s in [seeds(w, mask, no)]
        ]
        self.hash, self.item, self.at = (
            np.concatenate([f[j] for f in found]) if found else np.empty(0, t) for j, t in ((0, np.uint64), (1, np.int32), (2, np.int32))
        )
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]
        # A table of bits that answers most positions of a text without a search.
        self.met = np.zeros(1 << _FILTER_BITS, bool)
        self.met[self._slot(self.hash)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def hits(self, text: bytes) -> list[dict]:
        """The best place of each item that the text leaks."""
        words = word_hashes(text)
        looked: set[tuple[int, int]] = set()
        for no, mask in enumerate(self.masks):
            own = seeds(words, mask, no)
            where = np.flatnonzero(self.met[self._slot(own)])
            first = np.searchsorted(self.hash, own[where], "left")
            last = np.searchsorted(self.hash, own[where], "right")
            for p, a, b in zip(where.tolist(), first.tolist(), last.tolist()):
                looked.update(zip(self.item[a:b].tolist(), (p - self.at[a:b]).tolist()))
        best: dict[int, tuple] = {}
        for item, offset in looked:
            found = overlap(words, self.words[item], offset)
            if found and (item not in best or (-found[2], found[0]) < (-best[item][2], best[item][0])):
                best[item] = found
        return sorted(
            ({"item_id": self.ids[i], "start": s, "words": n, "matched": m} for i, (s, n, m) in best.items()), key=lambda h: h["item_id"]
        )


def overlap(words: np.ndarray, item: np.ndarray, offset: int) -> tuple[int, int, int] | None:
    """(start, words, matched) of what an item, shifted by offset, leaves in a text: from
    the first to the last stretch of NEED words that agree well enough."""
    need, misses = (NEED, MISSES) if len(item) >= NEED else (len(item), 0)
    a, b = max(0, offset), min(len(words), offset + len(item))
    if b - a < need:
        return None
    same = words[a:b] == item[a - offset : b - offset]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[need:] - sums[:-need] >= need - misses)
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + need
    return a + start, end - start, int(sums[end] - sums[start])


def _blocks(benchmark: DataFrame, ident: str, text: str, block_words: int):
    """The benchmark in blocks of about block_words words, one after the other."""
    items = benchmark.select(F.col(ident).cast("long").alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null")
    blank = F.trim(F.regexp_replace(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    items = materialize(items.withColumn("key", blank).groupBy("key").agg(F.min("item_id").alias("item_id")), "benchmark")
    # A word takes two characters at least, with the blank after it.
    size = items.agg(F.sum(F.char_length("key") / 2 + 1).alias("n")).first().n or 0
    count = max(1, -(-int(size) // block_words))
    for b in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b)
        rows = part.select("item_id", F.encode("key", "UTF-8").alias("text")).orderBy("item_id").toArrow()
        if rows.num_rows:
            yield Block(list(zip(rows.column(0).to_pylist(), texts_of(rows.column(1)))))


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns, with hits: the items each text leaks, by item."""
    spark = docs.sparkSession
    (name,) = free_names(docs.columns, "hits")
    schema = StructType([*docs.schema.fields, StructField(name, HITS)])
    position = docs.columns.index(text)
    sent = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, item_id, item_text, block_words)]
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("matched", pa.int32())]))
    if not sent:
        return docs.withColumn(name, F.array().cast(HITS))
    out = docs.withColumn(name, F.lit(None).cast(HITS))
    for block in sent:

        def run(batches, block=block):
            for batch in batches:
                found = [block.value.hits(t) for t in texts_of(batch.column(position))]
                earlier = batch.column(batch.num_columns - 1)
                if earlier.null_count < len(earlier):
                    found = [(e or []) + f for e, f in zip(earlier.to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], schema.names)

        out = out.mapInArrow(run, schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start, words, matched): one row for each document and leaked item."""
    found = scan(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")), benchmark, **options)
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
