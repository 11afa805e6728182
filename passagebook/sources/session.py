"""Session helpers: a local session for tests, and the folder shared by a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("passagebook")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # One thread per task: Spark already keeps all cores busy.
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
        .config("spark.driver.memory", os.environ.get("PASSAGEBOOK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="passagebook-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="passagebook-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: the plan is cut, and the rows are safe
    when executors are lost."""
    path = scratch_path(df.sparkSession, label)
    _written.add(path)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Paths that materialize wrote, and those of each open scope.
_written: set[str] = set()
_scopes: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _is_read(path: str, files: list[str]) -> bool:
    part = f"/{path.rsplit('/', 1)[1]}/"
    return any(part in f for f in files)


class Scratch:
    """A scope for tables that `materialize` writes. When it ends they are removed, but those
    that a DataFrame given to `keep` still reads: these belong to the scope around it, if
    there is one.

        with Scratch(spark) as scratch:
            return scratch.keep(work())
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, []

    def __enter__(self) -> Scratch:
        _scopes.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept += df.inputFiles()
        return df

    def __exit__(self, *failure) -> None:
        outer = _scopes[-2] if len(_scopes) > 1 else []
        for path in _scopes.pop():
            if _is_read(path, self.kept):
                outer.append(path)
            else:
                _written.discard(path)
                _remove(self.spark, path)


def discard(df: DataFrame) -> None:
    """Remove the table that `materialize` wrote for df, once nothing reads it any more."""
    files = df.inputFiles()
    found = [p for p in _written if _is_read(p, files)]
    if len(found) > 1 or (files and not found):
        raise ValueError("not a table that was written to the shared folder")
    for path in found:
        _written.discard(path)
        _remove(df.sparkSession, path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, which may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="passagebook-zip-"), "passagebook")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), "passagebook"))
        _shipped.add(app)
