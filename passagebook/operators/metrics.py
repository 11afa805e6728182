"""Task run records and the reports on them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.schemas import TASK_LOGS, conform

# Log lines kept with a run record.
LOG_LINES = 100


def run_record(
    spark: SparkSession,
    task_name: str,
    run_timestamp: datetime,
    duration_seconds: float,
    status: str,
    records_processed: int = 0,
    records_failed: int = 0,
    metrics: dict | None = None,
    error_message: str | None = None,
    logs: Sequence[dict] = (),
) -> DataFrame:
    """One row for the task log, in its declared schema."""
    row = (
        task_name,
        run_timestamp,
        float(duration_seconds),
        status,
        int(records_processed),
        int(records_failed),
        json.dumps(metrics or {}, sort_keys=True),
        error_message,
        json.dumps(list(logs)[-LOG_LINES:]),
    )
    return spark.createDataFrame([row], TASK_LOGS.struct())


def run_records(runs: DataFrame) -> DataFrame:
    """Rows for the task log, in its declared schema, from rows with at least task_name,
    run_timestamp, duration_seconds, status and records_processed; what else a record holds
    is taken where it is given, and has no failures, metrics, message or lines otherwise."""
    given = {
        "records_failed": F.lit(0).cast("long"), "metrics": F.lit("{}"), "error_message": F.lit(None).cast("string"), "logs": F.lit("[]"),
    }
    return conform(runs.withColumns({n: c for n, c in given.items() if n not in runs.columns}), TASK_LOGS)


def recent_runs(logs: DataFrame, reference: Column, days: int = 7) -> DataFrame:
    """Runs after `reference` minus `days`, newest first."""
    since = reference - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        logs.filter(F.col("run_timestamp") > since)
        .select("task_name", "status", "records_processed", "duration_seconds", "run_timestamp")
        .orderBy(F.col("run_timestamp").desc(), "task_name")
    )


def metric_rollup(logs: DataFrame) -> DataFrame:
    """Per task and metric name: sum over all runs; with the task's runs and failure rate.

    A task without metrics has one row with no metric. A value that is no number counts as null. Both parts are plain sums, so a task with
    most of the rows is reduced before the shuffle.
    """
    runs = logs.groupBy("task_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
    )
    parsed = F.from_json("metrics", "map<string,string>")
    sums = (
        logs.select("task_name", F.explode(parsed).alias("metric", "value"))
        .groupBy("task_name", "metric")
        .agg(F.sum(F.col("value").try_cast("double")).alias("total"))
    )
    return runs.join(sums, "task_name", "left").select(
        "task_name",
        "metric",
        "total",
        "runs",
        "failed_runs",
        (F.col("failed_runs") / F.col("runs")).alias("failure_rate"),
    )
