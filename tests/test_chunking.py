import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagebook.functions.text import SPACE
from passagebook.operators import chunking
from passagebook.operators.ingest import ingest, ingest_counted, new_documents, with_path_id
from passagebook.settings import Settings

TEXTS = st.text(alphabet="ab. !?\n\tcé😀", max_size=120)


def chunks(spark, texts, fn, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    out = fn(docs, "text", **options)
    return [
        tuple(r) for r in out.select("document_id", "chunk_index", "start_char", "end_char", "content")
        .orderBy("document_id", "chunk_index").collect()
    ]


def loop_fixed(text, size, overlap):
    """Window by window, the slow way."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        body = text[start:end].strip(SPACE)
        if body:
            out.append((len(out), start, end, body))
        start = end - overlap
        if start >= len(text) - overlap:
            break
    return out


def test_fixed_alphabet(spark):
    got = chunks(spark, ["abcdefghijklmnopqrstuvwxyz"], chunking.fixed_windows, size=10, overlap=3)
    assert got == [
        (0, 0, 0, 10, "abcdefghij"),
        (0, 1, 7, 17, "hijklmnopq"),
        (0, 2, 14, 24, "opqrstuvwx"),
        (0, 3, 21, 26, "vwxyz"),
    ]


def test_fixed_edges(spark):
    got = chunks(spark, ["ab", " " * 30, "", "x" * 5 + " " * 20 + "y" * 5], chunking.fixed_windows, size=10, overlap=3)
    assert got[0] == (0, 0, 0, 2, "ab")
    assert [g[0] for g in got] == [0, 3, 3]
    assert [g[1] for g in got if g[0] == 3] == [0, 1]


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4), (512, 50)])
def test_fixed_equals_loop(spark, size, overlap):
    texts = [("word. " * n + "é😀\n")[: 7 * n] for n in range(60)]
    got = chunks(spark, texts, chunking.fixed_windows, size=size, overlap=overlap)
    want = [(i, *c) for i, t in enumerate(texts) for c in loop_fixed(t, size, overlap)]
    assert got == want


def test_long_document(spark):
    text = "".join(f"w{i} " for i in range(200_000))
    got = chunks(spark, [text], chunking.fixed_windows, size=512, overlap=50)
    assert [g[1:] for g in got] == loop_fixed(text, 512, 50)


@pytest.mark.parametrize("fn", [*chunking.STRATEGIES.values(), chunking.hard_windows])
def test_overlap_must_be_smaller(spark, fn):
    docs = spark.createDataFrame([(1, "a")], "document_id long, text string")
    for size, overlap in [(10, 10), (10, 11), (0, 0), (10, -1)]:
        with pytest.raises(ValueError):
            fn(docs, "text", size, overlap)


def test_hard_windows(spark):
    got = chunks(spark, ["b" * 16], chunking.hard_windows, size=10, overlap=3)
    assert [(g[2], len(g[4])) for g in got] == [(0, 10), (7, 9), (14, 2)]


def test_sentence_cases(spark):
    text = "A b. C d!  E"
    assert [c[1:] for c in chunks(spark, [text], chunking.sentence_chunks, size=9, overlap=3)] == [
        (0, 0, 9, "A b. C d!"),
        (1, 11, 12, "E"),
    ]
    assert [c[1:] for c in chunks(spark, [text], chunking.sentence_chunks, size=8, overlap=3)] == [
        (0, 0, 4, "A b."),
        (1, 4, 10, "C d! E"),
    ]
    assert [len(c[4]) for c in chunks(spark, ["x" * 600], chunking.sentence_chunks)] == [600]


def test_recursive_has_no_copy(spark):
    got = chunks(spark, ["aaaa. " + "b" * 16 + ". cc"], chunking.recursive_chunks, size=10, overlap=3)
    bodies = [g[4] for g in got]
    assert bodies.count("aaaa") == 1 and bodies[-1] == "cc"


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40), st.data())
def test_recursive_spans(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    found = list(chunking.recursive_spans(text, size, overlap))
    for start, body in found:
        assert text[start : start + len(body)] == body
        assert 0 < len(body) <= size and body.strip(SPACE) == body
    covered = set()
    for start, body in found:
        covered.update(range(start, start + len(body)))
    left = {i for i, c in enumerate(text) if i not in covered}
    assert all(text[i] in SPACE + ".!?" for i in left)
    if overlap == 0:
        assert sum(len(b) for _, b in found) == len(covered)
    assert [s for s, _ in found] == sorted(s for s, _ in found)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_sentences_equal_lookbehind(text):
    want = re.split("(?<=[.!?])[" + SPACE + "]+", text)
    assert chunking.split_sentences(text) == want


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_sentence_spans(text, size):
    bodies = [b for _, b in chunking.sentence_spans(text, size, 0)]
    squeeze = re.compile("[" + SPACE + "]+")
    assert squeeze.sub("", "".join(bodies)) == squeeze.sub("", text)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 40), st.data())
def test_sentence_starts(text, size, data):
    """As a search through all of the text finds them, but for collapsed chunks."""
    overlap = data.draw(st.integers(0, size - 1))
    done = 0
    for start, body in chunking.sentence_spans(text, size, overlap):
        assert start >= 0
        if start != done:
            assert start == text.find(body, max(0, done - overlap))
        if body not in text:
            assert start == done
        done = start + len(body)


def test_sentence_starts_do_not_search_the_rest():
    """Every chunk has a collapsed gap; a search to the end of the text would take minutes."""
    text = "\n".join(f"sentence number {i} here." for i in range(400_000))
    began = time.perf_counter()
    assert sum(1 for _ in chunking.sentence_spans(text, 512, 50)) > 20_000
    assert time.perf_counter() - began < 20


def test_unknown_strategy(spark):
    docs = spark.createDataFrame([(1, "a")], "document_id long, text string")
    with pytest.raises(ValueError):
        chunking.chunk(docs, strategy="other")


def test_ingest_rows(spark, tmp_path):
    source = spark.createDataFrame(
        [("a", "x/a.wav", "One two. " * 200, '{"doc_type":"call"}'), ("b", "x/b.wav", "", None), ("c", "x/c.wav", "hi", "{oops")],
        "transcription_id string, audio_file_path string, text string, metadata string",
    )
    now = F.lit("2024-01-01").cast("timestamp")
    out = ingest(source, now, Settings())
    rows = out.collect()
    assert {r.document_id for r in rows} == {"a", "c"}
    assert all(r.embedding is None for r in rows)
    by_doc = {r.document_id: r.metadata for r in rows}
    assert by_doc["a"] == '{"doc_type":"call","source_path":"x/a.wav"}'
    assert by_doc["c"] == '{"doc_type":"transcription","source_path":"x/c.wav"}'
    assert len({r.chunk_id for r in rows}) == len(rows)
    kept = []
    stats = ingest_counted(source, now, lambda df: kept.append(df.write.mode("overwrite").parquet(str(tmp_path / "chunks"))), Settings())
    assert stats == {"status": "success", "documents_processed": 3, "chunks_created": len(rows)} and len(kept) == 1
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == len(rows)
    ledger = source.select(F.col("transcription_id").alias("document_id"))
    assert new_documents(source, ledger).isEmpty()
    for none in (source.limit(0), source.filter("false")):
        stats = ingest_counted(none, now, lambda df: df.write.mode("overwrite").parquet(str(tmp_path / "none")), Settings())
        assert stats == {"status": "no_new_data", "documents_processed": 0, "chunks_created": 0}


def test_blank_long_sentence_is_kept(spark):
    assert chunks(spark, [" " * 600], chunking.sentence_chunks)[0][4] == " " * 600


def test_path_id(spark):
    import hashlib

    df = spark.createDataFrame([("x/ä.wav",)], "audio_file_path string")
    assert with_path_id(df).first().document_id == hashlib.sha256("x/ä.wav".encode()).hexdigest()[:16]
