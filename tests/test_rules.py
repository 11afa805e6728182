import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from passagebook.functions.models import ExtractiveGenerator, HashedWords, split_words, with_retry
from passagebook.functions.text import metadata_json, overlay, parse_metadata, preview, token_count
from passagebook.operators import answers, embedding, graph, validation, search
from passagebook.settings import Settings
from passagebook.sources.session import scratch_path
from passagebook.streaming import ingest as stream

DIM = Settings(embedding_dimension=64)


def found(df):
    return sorted((r.row_id, r.level, r.field) for r in df.collect())


def test_chunk_rules(spark):
    rows = [
        ("len9", "d", "x" * 9, 0), ("len10", "d", "x" * 10, 0), ("max", "d", "x" * 10000, 0),
        ("over", "d", "x" * 10001, 0), ("blank", "d", " " * 12, 0), ("minus", "d", "x" * 20, -1),
        (None, "", None, None),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, document_id string, content string, chunk_index int")
    got = validation.validate_chunks(df)
    assert found(got) == [
        ("blank", "error", "content"), ("len9", "warning", "content"), ("minus", "error", "chunk_index"),
        ("over", "warning", "content"), ("unknown", "error", "chunk_id"), ("unknown", "error", "content"),
        ("unknown", "error", "document_id"),
    ]
    assert got.filter("row_id = 'len9'").first().message == "Content too short (9 chars)"
    report = validation.chunk_quality_report(df).first()
    assert (report.total_records, report.valid_records, report.invalid_records, report.is_valid) == (7, 4, 3, False)


def test_vector_rules(spark):
    unit = [1.0] + [0.0] * 63
    rows = [
        ("null", None), ("none", []), ("short", unit[:63]), ("zero", [0.0] * 64), ("nan", [math.nan] + unit[1:]),
        ("inf", [math.inf] + unit[1:]), ("big", [1000.0] + [0.0] * 63), ("ok", unit),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    assert [(i, level) for i, level, _ in found(validation.validate_embeddings(df, DIM))] == [
        ("big", "warning"), ("inf", "error"), ("inf", "warning"), ("nan", "error"), ("none", "error"),
        ("null", "error"), ("short", "error"), ("zero", "warning"),
    ]
    assert validation.validate_embeddings(df, DIM).filter("row_id = 'big'").first().message == "Embedding norm too large: 1000.0000"


def test_transcription_rules(spark):
    rows = [("null", None), ("zero", 0.0), ("edge", 36000.0), ("long", 36001.0), ("nan", math.nan)]
    df = spark.createDataFrame([(i, "x" * 10, d) for i, d in rows], "transcription_id string, text string, duration_seconds float")
    assert found(validation.validate_transcriptions(df)) == [
        ("long", "warning", "duration_seconds"), ("zero", "error", "duration_seconds"),
    ]


@pytest.mark.parametrize("embedded,warned", [(89, 1), (90, 0)])
def test_coverage(spark, embedded, warned):
    unit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i == 0).cast("float"))
    df = spark.range(100).select(
        F.col("id").cast("string").alias("chunk_id"), F.when(F.col("id") < embedded, unit).alias("embedding")
    )
    row = validation.embedding_coverage(df, DIM).first()
    assert (row.issue_count, row.valid_records, row.is_valid) == (warned, embedded, True)
    assert row.coverage == embedded / 100


def test_sampled_report_scales(spark):
    df = spark.range(2000).select(
        F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"),
        F.when(F.col("id") % 2 == 0, F.lit("x" * 20)).otherwise(F.lit(" " * 20)).alias("content"),
    )
    row = validation.chunk_quality_report(df, fraction=0.5).first()
    assert row.total_records == 2000 and 800 < row.checked_records < 1200
    assert row.valid_records == math.floor(2000 * (row.checked_records - row.issue_count) / row.checked_records)


def test_issue_views(spark):
    df = spark.createDataFrame([("a", "d", "x", -1), ("b", "d", "y", 0)], "chunk_id string, document_id string, content string, chunk_index int")
    got = validation.validate_chunks(df)
    assert {(r.level, r.field): r.n_issues for r in validation.issue_summary(got).collect()} == {
        ("warning", "content"): 2, ("error", "chunk_index"): 1,
    }
    assert validation.issue_head(got, 2).count() == 2
    assert validation.errors(got).count() == 1 and validation.warnings(got).count() == 2


def test_text_cases(spark):
    df = spark.createDataFrame([("x" * 200,), ("x" * 201,)], "t string")
    assert [len(r[0]) for r in df.select(preview(F.col("t"))).collect()] == [200, 203]
    bad = spark.createDataFrame([("{oops",), (None,), ("[1]",), ('{"a": 1}',)], "m string")
    assert [r[0] for r in bad.select(parse_metadata(F.col("m"))).collect()] == [{}, {}, {}, {"a": "1"}]
    maps = spark.createDataFrame([({"b": "1", "a": "1"}, {"a": "2"})], "x map<string,string>, y map<string,string>")
    assert maps.select(metadata_json(overlay(F.col("x"), F.col("y")))).first()[0] == '{"a":"2","b":"1"}'
    words = spark.createDataFrame([("  a\tb\n c ",), ("",), ("a b",)], "t string")
    assert [r[0] for r in words.select(token_count(F.col("t"))).collect()] == [3, 0, 1]
    assert [len(split_words(r.t)) for r in words.collect()] == [3, 0, 1]


def test_retry():
    pauses, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert with_retry(flaky, 3, 1.0, pauses.append) == ("ok", 3, None)
    assert pauses == [1.0, 2.0]
    assert with_retry(lambda: 1 / 0, 2, 0.0)[1:] == (2, "ZeroDivisionError: division by zero")


class Short:
    """Gives one vector too few for every batch with the word `lost`."""

    name, dim = "short", 4

    def embed(self, texts):
        return [[1.0, 0.0, 0.0, 0.0]] * (len(texts) - any("lost" in t for t in texts))


def test_lost_vectors_are_errors(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "lost"), ("c", "y")], "chunk_id string, content string")
    rows = embedding.embed_chunks(df, Short(), F.lit("2024-01-01").cast("timestamp"), batch_size=1, retry_delay=0.0).collect()
    assert {r.chunk_id: (r.embedding is None, r.error is None) for r in rows} == {
        "a": (False, True), "b": (True, False), "c": (False, True),
    }


def test_pending_and_merge(spark):
    chunks = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", []), ("d", None)], "chunk_id string, embedding array<float>")
    new = spark.createDataFrame([("b", [2.0], 1), ("b", [3.0], 2), ("c", None, 1)], "chunk_id string, embedding array<double>, created_at int")
    assert sorted(r.chunk_id for r in embedding.pending(chunks).collect()) == ["b", "c", "d"]
    assert sorted(r.chunk_id for r in embedding.pending(chunks, new).collect()) == ["c", "d"]
    merged = embedding.merge_embeddings(chunks, new)
    assert {r.chunk_id: r.embedding for r in merged.collect()} == {"a": [1.0], "b": [3.0], "c": [], "d": None}
    assert merged.schema["embedding"].dataType.simpleString() == "array<float>"


def test_chat(spark):
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", "one"), (1, 2, "assistant", "two"), (1, 3, "user", "three"),
        (2, 0, "user", "first"), (2, 1, "user", ""), (3, 0, "assistant", "hello"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    last = {r.conv_id: (r.query_text, r.status) for r in answers.last_user_message(df).collect()}
    assert last == {1: ("three", "success"), 2: ("", "error: no user message"), 3: ("", "error: no user message")}
    whole = {r.conv_id: r.prompt for r in answers.chat_transcript(df).collect()}
    assert whole[1] == "\nUser: one\nAssistant: two\nUser: three\nAssistant:"
    assert {r.conv_id: r.prompt for r in answers.chat_transcript(df, turns_per_part=2).collect()} == whole
    sparse = df.withColumn("turn", F.col("turn") * 10**9)
    assert {r.conv_id: r.prompt for r in answers.chat_transcript(sparse).collect()} == whole


class Picky(ExtractiveGenerator):
    def generate(self, questions, *others):
        if "fail" in questions:
            raise RuntimeError("model down")
        return super().generate(questions, *others)


class Echo:
    name = "echo"

    def generate(self, questions, contexts, prompts, system_prompt, max_tokens, temperature):
        return [(f"{len(questions)} {system_prompt} {max_tokens} {temperature}", 1) for _ in questions]


def test_generator_gets_batches_and_the_settings(spark):
    rows = [(str(i), "q", "c", "p") for i in range(5)]
    df = spark.createDataFrame(rows, "query_id string, query_text string, context string, prompt string").coalesce(1)
    s = Settings(batch_size=4, max_answer_tokens=7, temperature=0.25)
    got = sorted(r.response for r in answers.generate(df, Echo(), "be brief", s).collect())
    assert got == ["1 be brief 7 0.25"] + 4 * ["4 be brief 7 0.25"]
    short = ExtractiveGenerator().generate(["a"], ["one two three."], ["p"], "", 2, 0.0)
    assert short == [("one two", 3)]


def test_failing_row_does_not_stop_the_batch(spark):
    df = spark.createDataFrame(
        [("1", "fail", "c", "p"), ("2", "cat", "[Source: d]\nA dog. A cat! A cat.", "p q")],
        "query_id string, query_text string, context string, prompt string",
    )
    s = Settings(retry_delay=0.0)
    got = {r.query_id: r for r in answers.generate(df, Picky(), settings=s).collect()}
    assert got["1"].status == "error: RuntimeError: model down" and got["1"].tokens_used == 0
    # Words carry their punctuation, so no sentence shares a word: the first one wins.
    assert got["2"].response == "A dog." and got["2"].tokens_used == 4
    stats = answers.answer_stats(answers.generate(df, Picky(), settings=s)).first()
    assert tuple(stats) == (2, 1, 1)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "transcription_id string, audio_file_path string, text string, metadata string"

    def deliver(*ids):
        rows = [(i, f"{i}.wav", f"text of {i}. " * 50, None) for i in ids]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    s = Settings(embedding_dimension=16, chunking_strategy="sentence")
    now = F.lit("2024-01-01").cast("timestamp")

    def run():
        rows = stream.read_files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        stream.start(rows, stream.ingest_batches(target, now, s, HashedWords(16)), state).awaitTermination()

    deliver("a")
    deliver("b")
    run()
    before = spark.read.parquet(f"{target}/chunks").count()
    run()
    assert spark.read.parquet(f"{target}/chunks").count() == before
    deliver("c")
    run()
    from passagebook.operators.ingest import ingest

    want = ingest(spark.read.parquet(source), now, s)
    got = spark.read.parquet(f"{target}/chunks")
    assert {r.chunk_id for r in got.collect()} == {r.chunk_id for r in want.collect()}
    index = spark.read.parquet(f"{target}/index")
    assert index.count() == want.count() and index.select("batch").distinct().count() == 3


def test_graph_sample(spark):
    nodes = spark.createDataFrame([(c, 0.9) for c in "abcde"], "id string, confidence double")
    edges = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.6), ("b", "d", 0.59), ("c", "e", 0.9), ("d", "e", 0.9)],
        "src string, dst string, confidence double",
    )
    assert graph.graph_stats(nodes, edges).first().density == 0.25
    sure, kept = graph.graph_filter(nodes.filter("id != 'd'"), edges)
    assert sure.count() == 4 and sorted((r.src, r.dst) for r in kept.collect()) == [("a", "b"), ("a", "c"), ("c", "e")]
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hop for r in graph.k_hop(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}


class Names:
    def extract(self, texts):
        return [[("PERSON", w) for w in t.split() if w.istitle()] for t in texts]


class Beasts:
    def extract(self, texts):
        return [[("BEAST", t)] for t in texts]


def test_relations_pair_the_distinct_entities_of_a_chunk(spark):
    df = spark.createDataFrame(
        [("1", "Ann met Bob. then Cid saw Bob and Bob"), ("2", "on 2024-01-31 Bob and Ann"), ("3", "none here"), ("4", "Solo"), ("5", None)],
        "chunk_id string, content string",
    )
    got = {(r.src, r.dst): r.n_times for r in graph.relations(df).collect()}
    assert got == {("Ann", "Bob"): 2, ("Ann", "Cid"): 1, ("Bob", "Cid"): 1, ("2024-01-31", "Ann"): 1, ("2024-01-31", "Bob"): 1}
    found = graph.entity_mentions(df, extractor=Names())
    assert {tuple(r) for r in found.filter("chunk_id > '1'").collect()} == {
        ("2", "PERSON", "Bob"), ("2", "PERSON", "Ann"), ("4", "PERSON", "Solo"),
    }
    assert {(r.src, r.dst) for r in graph.relations(df, extractor=Names()).collect()} >= {("Ann", "Bob"), ("Ann", "Cid")}
    with pytest.raises(Exception, match="unknown entity types"):
        graph.entity_mentions(df, extractor=Beasts()).collect()


def test_dimension_check(spark):
    df = spark.createDataFrame([("a", None), ("b", []), ("c", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    got = {r.chunk_id: (r.n_dims, r.dim_ok) for r in embedding.dimension_check(df, 2).collect()}
    assert got == {"a": (0, False), "b": (0, False), "c": (2, True)}
    assert [tuple(r) for r in embedding.dimension_rejects(df, 3).collect()] == [("c", 2, 3)]


def test_search_passes_over_vectors_of_another_length(spark):
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<float>")
    for most in (4096, 0):
        got = search.top_k(asked, index, 5, columns=[], broadcast_queries=most).orderBy("rank").collect()
        assert [r.chunk_id for r in got] == ["a", "c"]


def test_scratch_is_new_every_time(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_goes_with_its_scope(spark):
    import os

    from passagebook.sources import session

    def there(df):
        return [os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()]

    rows = spark.range(3)
    outside = session.materialize(rows, "outside")
    with session.Scratch(spark) as outer:
        first = session.materialize(rows, "first")
        gone, gone_files = session.materialize(rows, "gone"), None
        with session.Scratch(spark) as inner:
            second, dropped = session.materialize(rows, "second"), session.materialize(rows, "dropped")
            dropped_files = dropped.inputFiles()
            inner.keep(second.join(first, "id"))
        assert all(there(second)) and not any(os.path.exists(f.removeprefix("file://")) for f in dropped_files)
        gone_files = gone.inputFiles()
        result = outer.keep(second.join(first, "id"))
    assert not any(os.path.exists(f.removeprefix("file://")) for f in gone_files)
    assert result.count() == 3 and all(there(outside))
    files = outside.inputFiles()
    session.discard(outside)
    assert result.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


#: What is fetched to the driver, and why its size is bounded whatever the tables hold.
FETCHED = {
    "search": ["queries.limit(limit + 1)", 'asked.select("cell").distinct()'],  # limited and measured; one per centroid
    "quantised": ['pieces.groupBy("part").applyInPandas(train, "part int, code int, entry array<double>")', 'sample.select("embedding")'],  # codebooks; a bounded sample
    "ledger": ["ids.select(*_hashes(key))", "possible_parts(wanted, path, key)"],  # two numbers an id, their number checked; one name a run
    "digests": ["differing(index, source)"],  # one number per bucket
    "balls": ['parts.groupBy("cell").agg(F.max("far").alias("far"), F.max("long").alias("long"))'],  # one row per centroid
}


def test_library_does_not_collect():
    """No result rows pass through the driver."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "passagebook"
    for path in (p for folder in ("operators", "plans", "streaming", "sources", "functions") for p in (root / folder).glob("*.py")):
        text = path.read_text()
        assert not re.findall(r"\.(collect|toPandas|toLocalIterator|crossJoin|localCheckpoint)\(", text), path
        fetched = re.findall(r"(?:= |\()([^=(\n]*(?:\(.*\))?)\.toArrow\(", text)
        assert len(fetched) == text.count(".toArrow(") == len(FETCHED.get(path.stem, [])), path
        assert all(any(f in allowed or allowed in f for allowed in FETCHED[path.stem]) for f in fetched), (path, fetched)


def _deliver(spark, folder, rows, schema="k string, day int, at timestamp"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_first_delivery_stays_however_late(spark, tmp_path):
    """Three restarts, each with its own deliveries; rows without a key are all kept."""
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    at = datetime(2024, 1, 1)

    def run():
        rows = stream.read_files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        stream.start(stream.first_deliveries(rows, "k"), stream.write_rows(target), state).awaitTermination()

    for keys in (["a", "b", "a", None], ["a", "late", None], ["late", "c", "b"]):
        _deliver(spark, source, [(k, 1, at) for k in keys])
        run()
    found = [r.k for r in spark.read.parquet(target).collect()]
    assert sorted(map(str, found)) == ["None", "None", "a", "b", "c", "late"]


def test_a_batch_reads_nothing_that_earlier_batches_wrote(spark, tmp_path):
    """Neither their folders, which are gone, nor more rows than it was brought."""
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    at, seen = datetime(2024, 1, 1), []
    for i in range(5):
        _deliver(spark, source, [(f"k{j}", i, at) for j in range(i, i + 10)])
        rows = stream.read_files(spark, source, spark.read.parquet(source).schema)
        query = stream.start(stream.first_deliveries(rows, "k"), stream.write_rows(f"{target}-{i}"), state)
        query.awaitTermination()
        seen += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(set(seen)) == 1 and len(seen) == 5
    assert [spark.read.parquet(f"{target}-{i}").count() for i in range(5)] == [10, 1, 1, 1, 1]


def test_keys_expire_by_watermark(spark, tmp_path):
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for day in (1, 2, 20, 21):
        _deliver(spark, source, [("b" if day == 20 else "a", day, datetime(2024, 1, day)), (f"b{day}", day, datetime(2024, 1, day))])
        rows = stream.read_files(spark, source, spark.read.parquet(source).schema)
        fresh = stream.first_deliveries(rows, "k", time="at", expire="5 days")
        query = stream.start(fresh, stream.write_rows(target), state)
        query.awaitTermination()
    found = sorted((r.k, r.day) for r in spark.read.parquet(target).collect())
    assert [d for k, d in found if k == "a"] == [1, 21]  # forgotten once the 20th has come, then new again
    kept = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert kept < 5


def test_incremental_run_takes_each_document_once(spark, tmp_path):
    """Delivered twice in a batch, late, and again after each of three restarts."""
    source, target, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "transcription_id string, audio_file_path string, text string, metadata string"
    s = Settings(embedding_dimension=16, chunking_strategy="sentence")
    now = F.lit("2024-01-01").cast("timestamp")
    for ids in (["a", "b", "a"], ["b", "c"], ["a", "b", "c", "d"]):
        _deliver(spark, source, [(i, f"{i}.wav", f"text of {i}. " * 50, None) for i in ids], schema)
        rows = stream.read_files(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
        stream.ingest_stream(rows, target, state, now, s, HashedWords(16)).awaitTermination()
    from passagebook.operators.ingest import ingest

    want = ingest(spark.read.parquet(source).dropDuplicates(["transcription_id"]), now, s)
    for part in ("chunks", "index"):
        got = [r.chunk_id for r in spark.read.parquet(f"{target}/{part}").collect()]
        assert sorted(got) == sorted(r.chunk_id for r in want.collect())


def test_streams_of_tables_in_several_files(spark, sf, tmp_path):
    """A table is one file or a folder of files; a stream of either holds all its rows."""
    from passagebook.plans import inputs, quality

    for name in ("documents", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    want = {r.document_id: r.n for r in inputs.chunk_rows(spark, sf).groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    for folder in (sf, str(tmp_path)):
        got = quality.stream_ingest(spark, folder).groupBy("document_id").agg(F.count("*").alias("n"))
        assert {r.document_id: r.n for r in got.collect()} == want
        assert {r.document_id: r.n_chunks for r in quality.stream_index(spark, folder).collect()} == want
        assert quality.stream_dedupe(spark, folder).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_near_seeds_share_a_block(spark):
    rows = spark.createDataFrame([(f"s{i * 7919 % 640}",) for i in range(640)], "node string").repartition(4)
    blocks = {}
    for r in graph._numbered(rows.unionByName(rows)).collect():
        blocks.setdefault(r._block, []).append((int(r.seed[1:]), r._bit))
    assert sum(map(len, blocks.values())) == 640
    for held in blocks.values():
        numbers, bits = zip(*sorted(held))
        assert numbers[-1] - numbers[0] == len(held) - 1 and len(set(bits)) == len(held)


@pytest.mark.parametrize("batch_size", [1, 32, 700])
def test_embedding_holds_slices_of_whole_calls(batch_size):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": list(range(3000))})
    parts = list(embedding.in_slices(iter([batch, batch.slice(0, 0)]), batch_size))
    assert [n for p in parts for n in p.column(0).to_pylist()] == list(range(3000))
    assert all(p.num_rows <= max(512, batch_size) for p in parts)
    assert all(p.num_rows % batch_size == 0 for p in parts[:-1])
