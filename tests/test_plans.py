"""What the plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passagebook.operators import search
from passagebook.plans import inputs

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Columns the parquet scans read."""
    reads = [line.split("ReadSchema: struct<")[1] for line in plan(df).splitlines() if "ReadSchema" in line]
    return {c.split(":")[0] for r in reads for c in r.rstrip(">").split(",")}


def test_narrow_scans(spark, sf):
    assert scanned(QUERIES["incremental_anti_join"](spark, sf)) == {"doc_id", "source"}
    assert scanned(QUERIES["chunk_fixed"](spark, sf)) == {"doc_id", "text"}
    assert scanned(QUERIES["index_source_stats"](spark, sf)) <= {"doc_id", "vec_id", "embedding"}


def test_filter_reaches_the_scan(spark, sf):
    kept = search.with_filters(inputs.vectors(spark, sf), {"label": [1, 3]})
    assert "PushedFilters: [In(label, [1,3])]" in plan(kept)


@pytest.mark.parametrize(
    "name", ["chunk_fixed", "chunk_sentence", "chunk_recursive_rows", "chunk_hard", "validate_chunks", "document_ids", "metadata_parse"]
)
def test_no_shuffle(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Exchange hashpartitioning" not in text and "Exchange SinglePartition" not in text


@pytest.mark.parametrize("name", ["task_metric_rollup", "index_sync_diff", "co_mentions", "graph_stats"])
def test_partial_aggregates(spark, sf, name):
    assert "partial_" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_ingest", "stream_index", "stream_dedupe"}))
def test_no_pair_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_reports_scan_once(spark, sf):
    text = plan(QUERIES["rag_data_report"](spark, sf))
    assert text.count("documents.parquet") == 1


def test_long_conversation_is_whole(spark):
    """A conversation with most of the rows is one prompt with all its turns in order."""
    from passagebook.operators.answers import chat_transcript

    turns = spark.range(5000).select(
        F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("hi "), F.col("id")).alias("text"),
    )
    out = chat_transcript(turns)
    assert out.count() == 2001
    prompt = out.filter("conv_id = 1").first().prompt
    assert prompt == "".join(f"\nUser: hi {i}" for i in range(3000)) + "\nAssistant:"


def test_queries_without_what_the_training_operators_import(tmp_path):
    """A module they need that cannot be imported leaves all other queries."""
    import os
    import subprocess
    import sys

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not [n for n in q if n.startswith('op')], len(q)"
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, cwd=root)
