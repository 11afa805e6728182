from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagebook.functions.models import ExtractiveGenerator, HashedWords
from passagebook.operators import indexing, metrics, upsert
from passagebook.plans import jobs
from passagebook.schemas import DOCUMENT_CHUNKS, RAG_RESPONSES, TASK_LOGS, TRANSCRIPTIONS, TableSchema, conform
from passagebook.settings import Settings
from passagebook.sources import files, tables
from passagebook.sources.session import shared_folder

NOW = datetime(2024, 1, 1)


def test_types():
    struct = TableSchema((("a", "double", True), ("b", "BOOL", False))).struct()
    assert struct["a"].dataType == T.DoubleType() and struct["b"].dataType == T.BooleanType()
    assert not struct["b"].nullable
    with pytest.raises(ValueError):
        TableSchema((("a", "varchar", True),))
    with pytest.raises(ValueError):
        TableSchema((("a", "int", True),), ("b",))


def test_conform(spark):
    schema = TableSchema((("a", "int", False), ("b", "string", True)))
    df = spark.createDataFrame([("1", 2.0), ("3", None)], "a string, x double")
    out = conform(df, schema)
    assert out.columns == ["a", "b"] and [r.a for r in out.collect()] == [1, 3]
    with pytest.raises(ValueError):
        conform(df.drop("a"), schema)
    with pytest.raises(PySparkException):
        conform(spark.createDataFrame([(None,)], "a string"), schema).collect()


def test_settings_round_trip():
    s = Settings(chunk_size=100, similarity_threshold=0.0)
    assert Settings.from_dict(s.to_dict()) == s
    with pytest.raises(ValueError):
        Settings.from_dict({"volume": "x"})


def test_table_life(spark):
    schema = TableSchema((("k", "int", False), ("v", "string", True), ("day", "string", True)), ("day",))
    assert tables.read_table(spark, "life") is None
    assert tables.create_table(spark, "life", schema, "it's a table", {"origin": "test"}) == "created"
    assert tables.create_table(spark, "life", schema) == "exists"
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, day string")
    tables.append(rows, "life", schema)
    tables.append(rows.limit(1), "life", schema)
    assert spark.table("life").count() == 3
    tables.replace(spark.table("life").filter("k = 1"), "life")
    assert sorted(r.k for r in spark.table("life").collect()) == [1, 1]
    stats = tables.table_stats(spark.table("life")).first()
    assert stats.row_count == 2 and stats.num_files >= 1 and stats.size_bytes > 0
    assert tables.drop_table(spark, "life") == "dropped"
    assert tables.drop_table(spark, "life") == "not_found"
    assert tables.full_name("a.b", "s") == "a.b" and tables.full_name("b", "s", "c") == "c.s.b"


def test_setup_all(spark):
    first = tables.setup_all_tables(spark)
    assert set(first.values()) <= {"created", "exists"} and "rag_responses" in first
    assert set(tables.setup_all_tables(spark).values()) == {"exists"}
    for name, (schema, _) in tables.RUN_TABLES.items():
        assert spark.table(name).columns == schema.names
        tables.drop_table(spark, name)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, n int")
    source = spark.createDataFrame(
        [(2, "new", None, 1), (2, "newer", None, 2), (3, "c", 3, 1)], "k int, v string, n int, at int"
    )
    whole = upsert.upsert(target, source, "k", order=[F.col("at")])
    assert sorted(map(tuple, whole.collect())) == [(1, "a", 1), (2, "newer", None), (3, "c", 3)]
    some = upsert.upsert(target, source, "k", ["v"], order=[F.col("at")])
    assert sorted(map(tuple, some.collect())) == [(1, "a", 1), (2, "newer", 2), (3, "c", 3)]
    with pytest.raises(ValueError):
        upsert.upsert(target, source, "k", ["other"])


def test_hot_key_upsert(spark):
    """A third of the source is one key; the newest copy wins."""
    source = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    got = {r.k: r.v for r in upsert.latest(source, "k", [F.col("v")]).collect()}
    assert got[-1] == 2997 and len(got) == 2001


def test_zorder_of_many_columns(spark, tmp_path):
    """Bits of ten columns fit a long: rows that agree in all are neighbours, and files are ordered."""
    columns = [f"c{i}" for i in range(10)]
    df = spark.range(4000).select("id", *[(F.floor(F.col("id") / 1000) * 50).alias(c) for c in columns])
    path = str(tmp_path / "z")
    tables.zorder(df, columns, path, rows_per_file=1000)
    out = spark.read.parquet(path)
    assert out.count() == 4000
    spans = out.groupBy(F.input_file_name()).agg(F.min("c0").alias("lo"), F.max("c0").alias("hi")).collect()
    assert len(spans) > 1 and all(r.hi - r.lo <= 50 for r in spans)


def test_zorder_keeps_rows_and_spreads_hot_value(spark, tmp_path):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"),
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("s"),
        F.lit(5).alias("same"),
    )
    path = str(tmp_path / "z")
    tables.zorder(df, ["a", "s", "same"], path, rows_per_file=1500)
    back = spark.read.parquet(path)
    assert back.count() == 9000 and back.exceptAll(df).isEmpty()
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 3000


def test_inventory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.wav", "b.MP3", "c.txt", "in/d.ogg"):
        (tmp_path / name).write_bytes(b"1234")
    found = files.file_inventory(spark, str(tmp_path))
    assert sorted(r.extension for r in found.collect()) == ["mp3", "ogg", "wav"]
    assert {r.total_bytes for r in files.inventory_by_format(found).collect()} == {4}
    plan = found._jdf.queryExecution().toString()
    assert "content" not in plan.split("Physical Plan")[1]


def test_sync(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "chunk_id string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "chunk_id string, content_hash string")
    diff = {r.chunk_id: r.action for r in indexing.key_difference(old, new).collect()}
    assert diff == {"a": "unchanged", "b": "update", "c": "delete", "d": "insert"}
    done = indexing.apply_sync(old, new)
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, new.collect()))
    assert indexing.index_status(done, new).first().ready
    assert not indexing.index_status(old, new).first().ready


def test_source_stats(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [])], "chunk_id string, embedding array<float>")
    assert tuple(indexing.source_stats(df).first()) == ("success", 3, 1)
    assert indexing.source_stats(df.filter("chunk_id = 'b'")).first().status == "no_embeddings"
    assert indexing.source_stats(df.limit(0)).first().status == "no_data"


def test_run_record(spark):
    logs = [{"message": str(i)} for i in range(150)]
    row = metrics.run_record(spark, "t", NOW, 1, "success", metrics={"n": 3}, logs=logs).first()
    assert row.error_message is None and row.metrics == '{"n": 3}'
    assert row.logs.count("message") == 100 and '"149"' in row.logs


def test_rollup(spark):
    df = spark.createDataFrame(
        [("t", "success", '{"n": 1, "x": "word"}'), ("t", "failed", '{"n": 2}'), ("t", "success", "{bad")],
        "task_name string, status string, metrics string",
    )
    got = {r.metric: r for r in metrics.metric_rollup(df).collect()}
    assert got["n"].total == 3 and got["x"].total is None and got["n"].failure_rate == pytest.approx(1 / 3)


def test_jobs(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS jobs")
    t = jobs.Tables("jobs")
    s = Settings(embedding_dimension=64, chunking_strategy="sentence", chunk_size=60, chunk_overlap=5, similarity_threshold=0.3)
    model = HashedWords(64)
    assert jobs.ingest_job(spark, t, s, NOW)["status"] == "no_data"
    assert jobs.embed_job(spark, t, s, model, NOW)["status"] == "error"
    assert jobs.index_job(spark, t)["status"] == "error"

    def add(*rows):
        df = spark.createDataFrame(
            [(i, f"{i}.wav", text) for i, text in rows], "transcription_id string, audio_file_path string, text string"
        ).withColumn("created_at", F.lit(NOW))
        tables.append(df, t.transcriptions, TRANSCRIPTIONS)

    add(("a", "The cat sat on the mat. The dog ran in the park. Birds sing at dawn every day."), ("b", ""))
    first = jobs.full_batch(spark, t, s, model, NOW)
    assert first["ingest"]["documents_processed"] == 2 and first["ingest"]["chunks_created"] >= 2
    assert first["embed"]["chunks_embedded"] == first["ingest"]["chunks_created"]
    assert first["index"]["ready"] and first["index"]["covered"] == first["ingest"]["chunks_created"]
    # The empty document has no chunk, and is not picked again.
    assert jobs.ingest_job(spark, t, s, NOW)["status"] == "no_new_data"
    assert jobs.embed_job(spark, t, s, model, NOW)["status"] == "no_new_chunks"

    add(("c", "Snow falls in winter. Rain falls in spring."))
    second = jobs.full_batch(spark, t, s, model, NOW)
    assert second["ingest"]["documents_processed"] == 1
    assert second["index"]["ready"] and second["index"]["covered"] == spark.table(t.chunks).count()
    assert spark.table(t.index).count() == spark.table(t.chunks).count()
    assert jobs.index_job(spark, t, added_only=True)["added"] == 0
    # Changed and deleted chunks are taken over by an ordinary run.
    tables.replace(spark.table(t.index).filter("document_id = 'a'").withColumn("content_hash", F.lit("old")), t.index)
    whole = jobs.index_job(spark, t)
    assert whole["ready"] and whole["covered"] == spark.table(t.chunks).count()
    assert spark.table(t.chunks).select(*DOCUMENT_CHUNKS.names).count() == spark.table(t.vectors).count()
    # Vectors of a length that was not declared are set aside, not indexed.
    assert spark.table(t.rejects).count() == 0
    aside = jobs.index_job(spark, t, dim=32)
    assert aside["rejected"] == spark.table(t.rejects).count() == spark.table(t.chunks).count()
    assert spark.table(t.index).count() == 0 and jobs.index_job(spark, t, dim=64)["rejected"] == 0

    # A run lost between chunks and ledger does not write its chunks again.
    n = spark.table(t.chunks).count()
    tables.replace(spark.table(t.ledger).filter("document_id <> 'a'"), t.ledger)
    assert jobs.ingest_job(spark, t, s, NOW)["documents_processed"] == 1
    assert spark.table(t.chunks).count() == n and spark.table(t.ledger).count() == 3

    spark.createDataFrame([("1", "where does the dog ran"), ("2", "zzz")], "query_id string, query_text string").write.saveAsTable(t.queries)
    done = jobs.answer_job(spark, t, s, model, ExtractiveGenerator(), NOW, "r1")
    assert done == {"status": "success", "queries_processed": 2, "successful": 1, "failed": 1}
    answers = {r.query_id: r for r in spark.table(t.responses).collect()}
    assert answers["1"].response == "The dog ran in the park." and answers["2"].status == "error: no context"
    assert spark.table(t.responses).columns == RAG_RESPONSES.names
    assert answers["2"].sources == "[]"

    with pytest.raises(RuntimeError):
        jobs.logged(spark, t, "broken", NOW, lambda: (_ for _ in ()).throw(RuntimeError("boom")))
    log = spark.table(t.logs)
    assert log.columns == TASK_LOGS.names
    assert log.filter("status = 'failed'").first().error_message == "boom"
    assert log.filter("task_name = 'ingest'").count() == 2


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_rollup_keeps_tasks_without_metrics(spark):
    df = spark.createDataFrame([("t", "failed", "{}"), ("t", "success", None), ("u", "success", '{"n": 1}')], "task_name string, status string, metrics string")
    got = {r.task_name: (r.metric, r.runs, r.failed_runs) for r in metrics.metric_rollup(df).collect()}
    assert got == {"t": (None, 2, 1), "u": ("n", 1, 0)}


def test_upsert_refuses_copies(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(1, "x"), (1, "y")], "id int, v string")
    for most in (0, 100):
        with pytest.raises(Exception, match="several rows for one id"):
            upsert.upsert(target, source, "id", broadcast_rows=most).collect()
    assert {(r.id, r.v) for r in upsert.upsert(target, source, "id", order=[F.col("v")]).collect()} == {(1, "y"), (2, "b")}


@pytest.mark.parametrize("most", [0, 2, 100])
def test_upsert_with_null_keys_repeats_and_columns_of_its_own(spark, most):
    """Both ways give the same: copies in the target are all updated, a null key matches nothing."""
    target = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "n", 4)], "id int, v string, n int")
    source = spark.createDataFrame([(1, "x", "more"), (3, "y", "more"), (None, "z", "more")], "id long, v string, other string")
    want = {(1, "x", 1), (1, "x", 2), (2, "c", 3), (None, "n", 4), (3, "y", None), (None, "z", None)}
    got = upsert.upsert(target, source, "id", broadcast_rows=most)
    assert {tuple(r) for r in got.collect()} == want and got.columns == target.columns
    only = upsert.upsert(target, source.withColumn("n", F.lit(9)), "id", ["n"], broadcast_rows=most)
    assert {tuple(r) for r in only.collect()} == {(1, "a", 9), (1, "b", 9), (2, "c", 3), (None, "n", 4), (3, "y", 9), (None, "z", 9)}


def _shuffled(df):
    """What stands below each shuffle of a plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = text.splitlines()
    return [[rest for rest in lines[i + 1 :] if len(rest) - len(rest.lstrip(" :+-|")) > len(line) - len(line.lstrip(" :+-|"))] for i, line in enumerate(lines) if "Exchange" in line]


def test_a_bucketed_target_is_never_shuffled(spark):
    from passagebook.operators.embedding import merge_embeddings

    rows = spark.range(4000).select(F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("n"), F.lit(None).cast("array<float>").alias("embedding"))
    source = spark.range(3000, 5000).select(F.col("id").cast("string").alias("chunk_id"), (-F.col("id")).alias("n"))
    vectors = rows.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        target = tables.write_bucketed(rows, "bucketed_target", "chunk_id", 8)
        stored = tables.write_bucketed(vectors, "bucketed_vectors", "chunk_id", 8)
        merged = upsert.upsert(target, source, "chunk_id")
        assert merged.count() == 5000 and merged.filter("n < 0").count() == 2000
        deleted = upsert.delete_keys(target, source, "chunk_id")
        assert deleted.count() == 3000
        both = merge_embeddings(target, stored)
        assert both.filter("embedding is not null").count() == 4000
        for df in (merged, deleted, both):
            assert not any("bucketed_target" in line for below in _shuffled(df) for line in below)
        assert not _shuffled(both) and len(_shuffled(merged)) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        tables.drop_table(spark, "bucketed_target")
        tables.drop_table(spark, "bucketed_vectors")


def test_table_stats_count_empty_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).repartition(2).write.parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    files = list((tmp_path / "t").glob("*.parquet"))
    stats = tables.table_stats(spark.read.parquet(path)).first()
    assert (stats.row_count, stats.num_files, stats.size_bytes) == (10, len(files), sum(f.stat().st_size for f in files)) and len(files) == 3
    scan = tables.table_stats(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in scan
