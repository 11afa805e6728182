"""Inventory of files in a landing folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.schemas import AUDIO_METADATA, conform

# The audio formats taken in.
AUDIO_FORMATS = ("wav", "mp3", "m4a", "ogg", "webm")


def file_inventory(spark: SparkSession, folder: str, formats: Sequence[str] = AUDIO_FORMATS) -> DataFrame:
    """Files with one of the formats: path, extension, size and time. Content is not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "modificationTime")
        .withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
        .filter(F.col("extension").isin(*formats))
    )
    return conform(
        files.withColumnRenamed("length", "size_bytes").withColumnRenamed("modificationTime", "modified_at"),
        AUDIO_METADATA,
    )


def inventory_by_format(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("extension").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("size_bytes").alias("total_bytes"),
        F.max("modified_at").alias("newest"),
    )
