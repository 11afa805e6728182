"""Splitting documents into chunks.

Each operator takes a DataFrame with an id and a text column and returns one row per
chunk: the other columns as they were, then chunk_index, start_char, end_char, content
and chunk_id. All are narrow: no shuffle, one pass over the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagebook.functions.text import NOT_SPACE, SPACE, chunk_id, strip

# Where a recursive split may cut, coarse to fine.
SEPARATORS = (". ", "! ", "? ", "\n\n", "\n", " ", "\n", "\t")

_SENTENCE_GAP = re.compile("[.!?]([" + SPACE + "]+)")

# Rows and characters gathered before an Arrow batch is sent back.
_BATCH_ROWS = 4096
_BATCH_CHARS = 8_000_000


def check_window(size: int, overlap: int) -> None:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size={size} overlap={overlap}")


def _windows(text: Column, count: Column, size: int, step: int, finish) -> Column:
    """The first `count` windows of `size` characters, `step` apart, as structs
    (start_char, content).

    One pass of a pattern that moves on by a step and looks ahead by a window, so the work
    is linear in the text. Cutting windows with substring would count characters from the
    start of the text for each of them.
    """
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    return F.transform(
        F.slice(cut, F.lit(1), count),
        lambda w, k: F.struct((k * step).cast("int").alias("start_char"), finish(w).alias("content")),
    )


def _explode_windows(df: DataFrame, text: str, windows: Column, size: int) -> DataFrame:
    kept = F.filter(windows, lambda w: F.rlike(w["content"], F.lit(NOT_SPACE)))
    others = [c for c in df.columns if c != text]
    return (
        df.withColumn("_len", F.length(text))
        .select(*others, "_len", F.posexplode(kept).alias("chunk_index", "_w"))
        .select(
            *others,
            "chunk_index",
            F.col("_w.start_char").alias("start_char"),
            F.least(F.col("_w.start_char") + size, F.col("_len")).cast("int").alias("end_char"),
            F.col("_w.content").alias("content"),
        )
    )


def fixed_windows(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of a fixed size. Content is stripped, offsets are those of the whole window,
    and blank windows take no index. The last window starts before the final overlap."""
    check_window(size, overlap)
    step = size - overlap
    length = F.length(text)
    count = F.when(length == 0, 0).otherwise(
        F.greatest(F.lit(1), F.ceil((length - overlap) / step).cast("int"))
    )
    return _explode_windows(df, text, _windows(F.col(text), count, size, step, strip), size)


def hard_windows(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows to the very end of the text, not stripped; blank ones are dropped."""
    check_window(size, overlap)
    step = size - overlap
    count = F.ceil(F.length(text) / step).cast("int")
    return _explode_windows(df, text, _windows(F.col(text), count, size, step, lambda c: c), size)


def sentences_at(text: str) -> Iterator[tuple[int, str]]:
    """Cut at the space after a full stop, exclamation or question mark, as (start, sentence)."""
    start = 0
    for gap in _SENTENCE_GAP.finditer(text):
        yield start, text[start : gap.start(1)]
        start = gap.end(1)
    yield start, text[start:]


def split_sentences(text: str) -> list[str]:
    return [sentence for _, sentence in sentences_at(text)]


def sentence_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Sentences packed up to `size` with one space between them, as (start, content).

    A chunk starts at the first place of its content after the one before, less the overlap.
    A chunk that is not in the text where its first sentence starts, because spaces were
    collapsed, starts where the one before it ended. So no search goes past the chunk's own
    place, and all of them together are linear in the text.
    """
    done = 0

    def place(content, own):
        return text.find(content, max(0, done - overlap)) if text.startswith(content, own) else done

    packed, own = "", 0
    for at, sentence in sentences_at(text):
        if len(packed) + 1 + len(sentence) <= size:
            if not packed:
                own = at + len(sentence) - len(sentence.lstrip(SPACE))
            packed = f"{packed} {sentence}".strip(SPACE)
            continue
        if packed:
            start = place(packed, own)
            yield start, packed
            done = start + len(packed)
        packed, own = sentence, at
    if packed:
        yield place(packed, own), packed


def _runs(text: str, lo: int, hi: int, sep: str, size: int) -> Iterator[tuple[int, int]]:
    """Cut text[lo:hi] at `sep` and join neighbours while they fit, as spans.

    A span longer than `size` is a single part that this separator cannot cut.
    """
    start = end = at = lo
    while at <= hi:
        cut = text.find(sep, at, hi)
        part_end = hi if cut < 0 else cut
        if start == end:
            start, end = at, at
        if part_end - start <= size:
            end = part_end
        else:
            if end > start:
                yield start, end
            if part_end - at > size:
                yield at, part_end
                start = end = part_end
            else:
                start, end = at, part_end
        if cut < 0:
            break
        at = cut + len(sep)
    if end > start:
        yield start, end


def recursive_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Split at the coarsest separator that works, hard windows where none does.

    Spans carry their offsets down, so every chunk is the text at its start.
    """
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= size:
            body = text[lo:hi].strip(SPACE)
            if body:
                yield text.index(body, lo), body
        elif level == len(SEPARATORS):
            step = size - overlap
            todo.extend((i, min(i + size, hi), level) for i in reversed(range(lo, hi, step)))
        else:
            spans = [(a, b, level + 1) for a, b in _runs(text, lo, hi, SEPARATORS[level], size)]
            todo.extend(reversed(spans))


def _explode_spans(df: DataFrame, text: str, spans, size: int, overlap: int) -> DataFrame:
    """Run a span generator over every text, sending chunks back in bounded batches."""
    check_window(size, overlap)
    others = [c for c in df.columns if c != text]
    schema = T.StructType(
        [df.schema[c] for c in others]
        + [
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("content", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.select(others)

            def flush(rows, index, start, content):
                kept = carried.take(pa.array(rows, type=pa.int64()))
                ends = [s + len(c) for s, c in zip(start, content)]
                return pa.RecordBatch.from_arrays(
                    [
                        *kept.columns,
                        pa.array(index, type=pa.int32()),
                        pa.array(start, type=pa.int32()),
                        pa.array(ends, type=pa.int32()),
                        pa.array(content, type=pa.string()),
                    ],
                    names=[*others, "chunk_index", "start_char", "end_char", "content"],
                )

            rows, index, start, content, chars = [], [], [], [], 0
            for row, body in enumerate(batch.column(text)):
                for k, (at, piece) in enumerate(spans(body.as_py() or "", size, overlap)):
                    rows.append(row)
                    index.append(k)
                    start.append(at)
                    content.append(piece)
                    chars += len(piece)
                    if len(rows) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                        yield flush(rows, index, start, content)
                        rows, index, start, content, chars = [], [], [], [], 0
            if rows:
                yield flush(rows, index, start, content)

    return df.select(*others, text).mapInArrow(run, schema)


def sentence_chunks(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    return _explode_spans(df, text, sentence_spans, size, overlap)


def recursive_chunks(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    return _explode_spans(df, text, recursive_spans, size, overlap)


# The strategy names.
STRATEGIES = {
    "fixed": fixed_windows,
    "sentence": sentence_chunks,
    "recursive": recursive_chunks,
}


def chunk(
    df: DataFrame,
    id_col: str = "document_id",
    text: str = "text",
    strategy: str = "recursive",
    size: int = 512,
    overlap: int = 50,
) -> DataFrame:
    """Chunks of every document by the named strategy, each with its stable id."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    out = STRATEGIES[strategy](df, text, size, overlap)
    return out.withColumn(
        "chunk_id", chunk_id(F.col(id_col), F.col("chunk_index"), F.col("content"))
    )


# Block a text and a chunk are cut into for the offset check.
_BLOCK = 1024


def offset_check(chunks: DataFrame, documents: DataFrame, id_col: str = "document_id", text: str = "text") -> DataFrame:
    """document id, chunk_index and at_offset: is the text at start_char this content?

    Texts and chunks meet in blocks, so a long document is neither copied to each of its
    chunks nor kept in one task.
    """
    pattern = "(?s)(?=(.{{1,{}}})).{{1,{}}}"
    windows = F.regexp_extract_all(F.col(text), F.lit(pattern.format(2 * _BLOCK, _BLOCK)), F.lit(1))
    blocks = documents.select(id_col, F.posexplode(windows).alias("_block", "_window"))
    cut = F.regexp_extract_all(F.col("content"), F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    at = F.col("start_char") + F.col("_piece") * _BLOCK
    pieces = chunks.select(id_col, "chunk_index", "start_char", F.posexplode(cut).alias("_piece", "_text")).select(
        id_col,
        "chunk_index",
        F.floor(at / _BLOCK).cast("int").alias("_block"),
        F.pmod(at, F.lit(_BLOCK)).alias("_from"),
        "_text",
    )
    same = F.substring(F.col("_window"), F.col("_from") + 1, F.length("_text")) == F.col("_text")
    met = pieces.join(blocks, [id_col, "_block"], "left")
    return met.groupBy(id_col, "chunk_index").agg(F.min(F.coalesce(same, F.lit(False))).alias("at_offset"))
