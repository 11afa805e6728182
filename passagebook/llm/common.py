"""Small things the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as the character class and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"

#: For bytes.translate: A-Z to a-z, all else unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names of new columns, each with underscores behind it until no column has it,
    in whatever case: Spark does not tell Score from score."""
    used, out = {name.lower() for name in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged. lower() does just that where a
    text is ASCII, and is much the faster of the two."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(column) == F.length(column), F.lower(column)).otherwise(
        F.translate(column, upper, upper.lower())
    )


def crc_fold(column: Column, folds: int) -> Column:
    """crc32 of an id as text, modulo folds. A null id is in no fold (null)."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)


def crc_fold_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def row_key(ident: str, text: str) -> list[Column]:
    """128 bits for a row's id and text. Rows that agree in both share a key, which is right
    wherever what is found out about a row depends on nothing else."""
    return [
        F.xxhash64(F.col(ident), F.col(text)).alias("k1"),
        F.xxhash64(F.lit("row"), F.col(text), F.col(ident)).alias("k2"),
    ]


def texts_of(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty, without decoding."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def whole_texts(rows: DataFrame, most: int) -> DataFrame:
    """Of a bounded sample (id, label, text), in one partition, whole texts by the hash of
    their id until they have `most` bytes; the one that passes it is the last."""
    before = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))
    return sized.filter(F.col("before") < most).drop("before")


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
