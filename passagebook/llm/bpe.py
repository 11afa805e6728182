"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens. The most frequent words of a bounded sample are encoded once
and broadcast: they hold nearly all positions, a hot word among them, and their number is a
parameter. All other words are exploded, one row for each document and distinct word with
its positions, and shuffled by word; each word meets all its documents there and is encoded
once. The ids go back to the document, where they are put in at their positions. What does
not fit the sample so costs a shuffle but changes no result.

Decoding joins ids with the table of token bytes, whose size is that of the vocabulary.

Defined results: a null or empty text has no tokens. Words of any length are encoded in
near-linear time. Repeated rows each come back. All columns are kept; those added are named
ids and decoded, with an underscore after them where the input has such names. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from passagebook.llm.common import free_names, texts_of

#: Words that are broadcast, and rows of the sample in which they are counted.
FREQUENT = 500_000
SAMPLE_ROWS = 40_000
#: Pieces of texts from which a compression dictionary is made, their length, its size.
PIECES, PIECE_CHARS, DICTIONARY_BYTES = 1_500, 4_096, 400_000
#: Longer words are never broadcast.
LONGEST = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64, blank, rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the neighbours whose union has the lowest rank merge first, the
    leftmost of equals before others."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if not (alive[i] and alive[mid] and stop[i] == mid and stop[mid] == end):
            continue  # one of the two has merged with another part since
        alive[mid], stop[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : stop[end]])) is not None:
                heapq.heappush(heap, (r, i, end, stop[end]))
        p = before[i]
        if p >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out


def _packed(numbers: list[int], kind: str = "<u4") -> bytes:
    return np.array(numbers, dtype=kind).tobytes()


def _pack_positions(numbers: list[int]) -> bytes:
    """Rising positions in 16 bits each; in 32, with a byte more, where the last needs that."""
    return _packed(numbers, "<u2") if numbers[-1] <= 0xFFFF else _packed(numbers) + b"\0"


def _pack_fill(positions: bytes, ids: bytes) -> bytes:
    """How many bytes of positions, these, and the ids."""
    n = len(positions)
    return (bytes((n,)) if n < 255 else b"\xff" + n.to_bytes(4, "little")) + positions + ids


def _unpack_fill(fill: bytes) -> tuple[list[int], bytes]:
    n, at = (fill[0], 1) if fill[0] < 255 else (int.from_bytes(fill[1:5], "little"), 5)
    kind, count = ("<u4", n // 4) if n % 2 else ("<u2", n // 2)
    return np.frombuffer(fill, kind, count, at).tolist(), fill[at + n :]


class Vocabulary:
    """What the tasks need: ranks, the pattern and the frequent words with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, frequent: dict[str, bytes]):
        self.ranks, self.pattern, self.frequent = ranks, pattern, frequent
        self.tokens = None
        self._cut = None
        #: Shared beginnings for the compression of texts on their way, or none.
        self.phrases: bytes | None = None
        # Of ids on their way between tasks.
        self.kind = "<u2" if max(ranks.values(), default=0) <= 0xFFFF else "<u4"

    def cut(self, text: str) -> list[str]:
        if self._cut is None:
            self._cut = regex.compile(self.pattern)
        return self._cut.findall(text)

    def token_bytes(self) -> list[bytes]:
        if self.tokens is None:
            self.tokens = [b""] * (max(self.ranks.values()) + 1)
            for token, rank in self.ranks.items():
                self.tokens[rank] = token
        return self.tokens

    def packer(self):
        shared = zstandard.ZstdCompressionDict(self.phrases) if self.phrases else None
        return zstandard.ZstdCompressor(level=6, dict_data=shared).compress

    def unpacker(self):
        shared = zstandard.ZstdCompressionDict(self.phrases) if self.phrases else None
        return zstandard.ZstdDecompressor(dict_data=shared).decompress

    def __getstate__(self):
        return {**self.__dict__, "_cut": None, "tokens": None}


def _decoded(texts) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts_of(texts)]


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text: str, most: int) -> dict[str, bytes]:
    """The words to broadcast with their ids: at most `most`, of at most LONGEST characters."""

    def count(batches):
        for batch in _slices(batches):
            words: Counter = Counter()
            for t in _decoded(batch.column(0)):
                words.update(vocabulary.cut(t))
            names = [w for w in words if len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([words[w] for w in names], pa.int64())], ["word", "n"])

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    top = (
        docs.select(F.col(text).alias("text")).sample(share, seed=7)
        .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word").limit(most)
    )
    words = top.select("word").toArrow().column(0).to_pylist()
    return {w: _packed(encode_word(w.encode(), vocabulary.ranks), vocabulary.kind) for w in words}


def load(docs: DataFrame, path: str, pattern: str, text: str = "text", frequent: int = FREQUENT) -> Vocabulary:
    """A vocabulary for these documents from a file of ranks that the driver can read."""
    vocabulary = Vocabulary(read_ranks(path), pattern, {})
    vocabulary.frequent = frequent_words(docs, vocabulary, text, frequent)
    vocabulary.phrases = _phrases(docs, text)
    return vocabulary


def _phrases(docs: DataFrame, text: str) -> bytes | None:
    """A compression dictionary from pieces of a bounded sample; it changes sizes only."""
    share = min(1.0, 2 * PIECES / max(1, docs.count()))
    piece = F.substring(F.col(text), 1, PIECE_CHARS).alias("piece")
    pieces = [p for p in docs.sample(share, seed=5).select(piece).limit(PIECES).toArrow().column(0).to_pylist() if p]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [p.encode() for p in pieces]).as_bytes()
    except zstandard.ZstdError:  # too little text to gain by
        return None


def _slices(batches, rows: int = 2000):
    """Smaller batches, which bounds what a task holds of its texts in other forms."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _rare(vocabulary: Vocabulary):
    """(k1, k2, word, positions) of the words that are not broadcast."""
    known = vocabulary.frequent
    kinds = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("word", pa.string()), ("positions", pa.binary())])

    def run(batches):
        for batch in _slices(batches):
            rows, words, positions = [], [], []
            for row, text in enumerate(_decoded(batch.column(2))):
                found: dict[str, list[int]] = {}
                for i, w in enumerate(vocabulary.cut(text)):
                    if w not in known:
                        found.setdefault(w, []).append(i)
                rows += [row] * len(found)
                words += found
                positions += [_pack_positions(p) for p in found.values()]
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.string()), pa.array(positions, pa.binary())],
                schema=kinds,
            )

    return run


def _encode_words(vocabulary: Vocabulary):
    """Words in order become ids, each distinct word once, after their positions. A document that met the same word before, as repeated rows do, adds nothing."""

    def run(batches):
        last, ids = None, b""
        owner = None
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            keep, out = [], []
            for i, w in enumerate(batch.column(2).to_pylist()):
                if w != last:
                    last, ids, owner = w, _packed(encode_word(w.encode(), vocabulary.ranks), vocabulary.kind), None
                if owner != (k1[i], k2[i]):
                    owner = (k1[i], k2[i])
                    keep.append(i)
                    out.append(_pack_fill(batch.column(3)[i].as_py(), ids))
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], ["k1", "k2", "fill"])

    return run


def _pack(vocabulary: Vocabulary, position: int):
    """The text column compressed, for its way through the shuffle."""

    def run(batches):
        pack = vocabulary.packer()
        for batch in _slices(batches):
            columns = list(batch.columns)
            columns[position] = pa.array([pack(t) for t in texts_of(columns[position])], pa.large_binary())
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(batch.num_columns)])

    return run


def _assembled(vocabulary: Vocabulary, batches):
    """(row, packed text, fills): the row and its ids. Frequent words are looked up, the ids
    of all others are put in at their positions."""
    get = vocabulary.frequent.get
    unpack = vocabulary.unpacker()
    for batch in _slices(batches):
        out = []
        for packed, fills in zip(texts_of(batch.column(1)), batch.column(2)):
            parts = [get(w) for w in vocabulary.cut(unpack(packed).decode("utf-8", "replace"))]
            for fill in fills.as_py() or ():
                if fill[0] == 2:  # one position, as nearly always
                    parts[fill[1] | fill[2] << 8] = fill[3:]
                    continue
                positions, ids = _unpack_fill(fill)
                for position in positions:
                    parts[position] = ids
            out.append(np.frombuffer(b"".join(parts), vocabulary.kind).astype("<u4").tobytes())
        yield batch.column(0), pa.array(out, pa.large_binary())


def _token_bytes(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    token = vocabulary.token_bytes().__getitem__
    return pa.array([b"".join(map(token, np.frombuffer(i, "<u4").tolist())) for i in texts_of(ids)], pa.large_binary())


def _key(ident: str, text: str) -> list[Column]:
    """A row's id, or a hash of its text where it has none, and 32 bits of both. Rows that
    share a key by right have the same text; two texts of one id share it once in 2**32."""
    return [
        F.coalesce(F.col(ident).cast("long"), F.xxhash64(text)).alias("k1"),
        F.hash(F.col(text), F.col(ident)).alias("k2"),
    ]


def encode(docs: DataFrame, vocabulary: Vocabulary, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns but the text, with ids and decoded: the ids as little-endian unsigned
    32-bit numbers, and the bytes that decoding them gives."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    k1, k2 = _key(ident, text)
    rare = (
        docs.select(k1, k2, F.col(text).alias("text"))
        .mapInArrow(lambda it: _rare(sent.value)(it), "k1 long, k2 int, word string, positions binary")
        .repartition("word").sortWithinPartitions("word", "k1", "k2")
        .mapInArrow(lambda it: _encode_words(sent.value)(it), "k1 long, k2 int, fill binary")
    )
    fills = rare.groupBy("k1", "k2").agg(F.collect_list("fill").alias("fills"))
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    keyed = docs.select(row.alias("row"), k1, k2, F.col(text).alias("text"))
    kind = keyed.schema["row"].dataType.simpleString()
    packed = keyed.mapInArrow(lambda it: _pack(sent.value, 3)(it), f"row {kind}, k1 long, k2 int, packed binary")
    joined = packed.join(fills, ["k1", "k2"], "left").select("row", "packed", "fills")

    def finish(batches):
        for rows, ids in _assembled(sent.value, batches):
            yield pa.RecordBatch.from_arrays([rows, ids, _token_bytes(sent.value, ids)], ["row", "ids", "decoded"])

    out = joined.mapInArrow(finish, f"row {kind}, ids binary, decoded binary")
    new = [F.col(c).alias(n) for c, n in zip(("ids", "decoded"), free_names(others, "ids", "decoded"))]
    return out.select(*([F.col("row.*")] if others else []), *new)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """All columns, with decoded: the bytes of the ids in a column such as encode() makes.
    The table of token bytes is broadcast; it is as large as the vocabulary, never more."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    (name,) = free_names(rows.columns, "decoded")
    schema = StructType([*rows.schema.fields, StructField(name, BinaryType())])
    position = rows.columns.index(ids)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _token_bytes(sent.value, batch.column(position))], schema.names)

    return rows.mapInArrow(run, schema)
