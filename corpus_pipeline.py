"""The corpus pipeline: documents through five stages, each written and read again.

Language ID drops documents without any letter, and no others: where no row has a language
to learn from, documents with a letter stay all the same. Line dedup leaves the first of each line that
is found in ten or more documents. Near-dedup leaves one document of each group that is linked by
SimHash fingerprints of five-word shingles which differ in three bits or fewer. Decontamination drops documents that leak
an item of the benchmark. The last stage returns each document's tokens and what they decode
to.

What a stage writes on its way is removed when it returns, but for what its result still
reads; run() removes that too, and each stage's output once the next one is written.

Defined results, in every stage: a null text is empty (the first stage drops it); a row
without an id is a document like any other; repeated rows each count and each stay or go by
what the stage decides about their text, except that near-dedup leaves one of them; ties
go to the smaller id, and an id goes before none. Texts of any length are taken whole. Other
columns of the input are left out, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagebook.llm import bpe, decontaminate, language, linededup, simhash
from passagebook.llm.common import table
from passagebook.sources.session import Scratch, discard, materialize, ship_package

#: Words that the last stage broadcasts: fewer than the operator's default, as workers come to
#: it with what earlier stages left in their memory. All other words are shuffled.
BROADCAST_WORDS = 150_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _stage(work):
    """A stage that has the package on all workers and removes what it no longer needs."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        with Scratch(spark) as scratch:
            return scratch.keep(work(spark, docs, sf_dir))

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a null text has none. The model is learned from all of docs."""
    model = language.learn(docs.select("text", "lang"))
    if not model.languages:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    return language.predict(docs.select(*COLUMNS), model).filter("lang_pred <> 'und'").select(*COLUMNS)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more share, but for the first of each by
    doc_id and place. A text that loses none, null among them, stays as it is; n_chars is
    counted anew where one does."""
    docs = docs.select(*COLUMNS)
    bitmaps = linededup.keep_bitmaps(docs, least_docs=10, least_chars=1, keep_first=True)
    kept = linededup.apply(docs, bitmaps)
    lost = F.col("n_dropped") > 0
    return kept.select(
        "doc_id", F.when(lost, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(lost, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"),
    )


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints link: that of the smallest id, no id being
    the largest; of repeated rows one. Null texts and texts without words are one group."""
    return simhash.drop_linked(docs.select(*COLUMNS), size=5, most=3)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item; null and empty texts, and all where there are no items, stay."""
    found = decontaminate.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's tokens (little-endian, 32 bits each), how many they are, and the
    digest of what they decode to; a null or empty text has none."""
    docs = docs.select(*COLUMNS)
    vocabulary = bpe.load(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, frequent=BROADCAST_WORDS)
    return bpe.encode(docs, vocabulary).select(
        "doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's output goes once the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark) as scratch:
            docs = scratch.keep(materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
        if written is not None:
            discard(written)
        written = docs
    return docs


#: Trained models, approximate groups and tokens are beyond SQL; tests compare with plain code.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
