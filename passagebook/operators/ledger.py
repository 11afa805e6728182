"""A ledger of processed documents in parts, each with a Bloom filter.

Every run adds a part: the ids it processed, and for each million of them a filter of about
ten bits an id. A later run brings a few ids. Its ids are looked up in the filters first, which
are scanned where they lie; only parts with a possible match have their ids read. A filter
never misses an id, so the answer is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.sources.session import materialize

BITS_PER_ID = 10
HASHES = 7

# Ids of one filter, and ids of a run that are looked up in filters; more are joined as they are.
IDS_PER_FILTER = 1_000_000
MOST_NEW = 1_000_000

_FILTERS = "part string, sub int, n long, bits binary"


def _hashes(key: str):
    return F.xxhash64(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g")


def _places(h: np.ndarray, g: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits of each id, by double hashing."""
    h, g = h.view(np.uint64), g.view(np.uint64) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * g) % np.uint64(size)).astype(np.int64)


def add(ids: DataFrame, path: str, part: str, key: str = "document_id") -> None:
    """Add a part. One that is added again, after a run that failed, replaces itself."""
    rows = ids.select(F.col(key).cast("string").alias("document_id")).filter(F.col("document_id").isNotNull()).distinct()
    rows.write.mode("overwrite").parquet(f"{path}/ids/part={part}")
    stored = ids.sparkSession.read.schema("document_id string").parquet(f"{path}/ids/part={part}")
    subs = max(1, math.ceil(stored.count() / IDS_PER_FILTER))
    hashed = stored.select(F.pmod(F.xxhash64(F.lit("sub"), "document_id"), F.lit(subs)).cast("int").alias("sub"), *_hashes("document_id"))

    def build(key, group):
        size = -(-max(64, BITS_PER_ID * group.num_rows) // 8) * 8
        bits = np.zeros(size, np.uint8)
        for place in _places(group.column("h").to_numpy(), group.column("g").to_numpy(), size):
            bits[place] = 1
        return pa.table({
            "part": [part], "sub": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([group.num_rows], pa.int64()),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        })

    hashed.groupBy("sub").applyInArrow(build, _FILTERS).write.mode("overwrite").parquet(f"{path}/filters/part={part}")


def possible_parts(ids: DataFrame, path: str, key: str) -> DataFrame:
    """(part): the parts whose filters hold one of the ids, perhaps. The ids are broadcast as
    two hashes each; their number is the caller's to bound."""
    spark = ids.sparkSession
    hashed = ids.select(*_hashes(key)).toArrow()
    sent = spark.sparkContext.broadcast((hashed.column("h").to_numpy(), hashed.column("g").to_numpy()))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, g = sent.value
        for batch in batches:
            found = []
            for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits")):
                words = np.frombuffer(bits.as_py(), np.uint8)
                held = np.ones(len(h), bool)
                for place in _places(h, g, 8 * len(words)):
                    held &= (words[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                if held.any():
                    found.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["part"])

    filters = spark.read.schema(_FILTERS).parquet(f"{path}/filters").select("part", "bits")
    return filters.mapInArrow(look, "part string").distinct()


def _empty(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/filters")
    return not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def processed(ids: DataFrame, path: str, key: str = "document_id", most_new: int = MOST_NEW) -> DataFrame:
    """(document_id): those parts of the ledger that may hold one of the ids; the whole of it
    where there are more ids than are looked up."""
    spark = ids.sparkSession
    if _empty(spark, path):
        return spark.createDataFrame([], "document_id string")
    ledger = spark.read.schema("document_id string, part string").parquet(f"{path}/ids")
    wanted = materialize(ids.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct(), "ledger-ids")
    if wanted.count() > most_new:
        return ledger.select("document_id")
    parts = possible_parts(wanted, path, key).toArrow().column("part").to_pylist()  # one name a run
    return ledger.filter(F.col("part").isin(parts)).select("document_id")


def unseen(rows: DataFrame, path: str, key: str = "transcription_id", most_new: int = MOST_NEW) -> DataFrame:
    """Rows whose id no part of the ledger holds; rows without an id are unseen."""
    done = processed(rows.select(key), path, key, most_new).withColumnRenamed("document_id", "_done")
    return rows.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
