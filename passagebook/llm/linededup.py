"""Line dedup with DataFrame functions only.

Every line becomes 128 bits of its key beside the document and the position. The rows are
dealt by range of (key, document) and sorted by position within it, so that a key which
holds a third of all lines is spread over many tasks, and the first occurrence of a key in
a document streams past before the later ones. Documents are then counted by key. What is
returned is no text but, for each document that loses lines, a compressed bitmap of the
lines it keeps: words of 64 lines, of which only those with a lost line are stored.

Defined results: a null or empty text is one empty line. A document is an id: rows that
share an id (null is an id too) count once. Repeated rows each come back, with the same
lines lost. Columns other than id and text are kept by apply() and ignored elsewhere; names
that clash with those used here are not touched. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebook.llm.common import SPACE, free_names, lower_ascii, row_key
from passagebook.sources.session import materialize

#: Keys that may be broadcast: 16 bytes each. Beyond it the join is a shuffle.
BROADCAST_KEYS = 1 << 20
#: Parts into which the lines of one key are dealt in that join.
SALTS = 16


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, ident: str = "doc_id", text: str = "text", least_chars: int = 1) -> DataFrame:
    """(h1, h2, doc_id, k1, k2, pos) of every line whose key has enough characters."""
    keys = F.split(lower_ascii(F.col(text)), "\n")
    key = F.trim(F.col("line"), F.lit(SPACE))
    return (
        docs.select(F.col(ident).cast("long").alias("doc_id"), *row_key(ident, text), F.posexplode(keys).alias("pos", "line"))
        .withColumn("line", key)
        .filter(F.char_length("line") >= least_chars)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "doc_id", "k1", "k2", "pos")
    )


def lost_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False,
               ident: str = "doc_id", text: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(k1, k2, pos) of the lines to lose: those whose key is found in enough documents.

    keep_first: the first line of each key, by document and position, stays.
    """
    spark = docs.sparkSession
    lines = line_hashes(docs, ident, text, least_chars)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        lines.repartitionByRange(parts, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos"),
        "lines",
    )
    first = F.min(F.struct("doc_id", "pos", "k1", "k2"))
    in_document = ranged.groupBy("h1", "h2", "doc_id").agg(F.min(F.struct("pos", "k1", "k2")).alias("at"))
    common = (
        in_document.select("h1", "h2", "doc_id", "at.pos", "at.k1", "at.k2")
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), first.alias("first"))
        .filter(F.col("n") >= least_docs)
        .select("h1", "h2", F.col("first.pos").alias("f_pos"), F.col("first.k1").alias("f_k1"), F.col("first.k2").alias("f_k2"))
    )
    common = materialize(common, "common-lines")
    if common.count() <= broadcast_keys:
        met = ranged.join(F.broadcast(common), ["h1", "h2"])
    else:
        salted = common.withColumn("salt", F.explode(F.array([F.lit(i) for i in range(SALTS)])))
        met = ranged.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    if keep_first:
        same = (F.col("pos") == F.col("f_pos")) & (F.col("k1") == F.col("f_k1")) & (F.col("k2") == F.col("f_k2"))
        met = met.filter(~same)
    return met.select("k1", "k2", "pos")


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(k1, k2, keep): for each document that loses lines, words (word, bits) of 64 lines
    in which a set bit is a kept line. A word that is not stored keeps all its lines."""
    lost = lost_lines(docs, **options).withColumn("word", F.expr("cast(shiftright(pos, 6) as int)"))
    words = lost.groupBy("k1", "k2", "word").agg(
        F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))"))).alias("bits")
    )
    return words.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def apply(docs: DataFrame, bitmaps: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with n_lines, n_dropped and kept_text."""
    names = docs.columns
    k1, k2 = row_key(ident, text)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), k1, k2)
    joined = keyed.join(bitmaps.select("k1", "k2", "keep"), ["k1", "k2"], "left")
    # Dense from sparse words: words that are left out stand for 64 kept lines.
    dense = F.expr(
        "flatten(transform(keep, (x, i) -> concat("
        "array_repeat(-1L, x.word - if(i = 0, 0, keep[i - 1].word + 1)), array(x.bits))))"
    )
    lines = split_lines(F.col(f"row.`{text}`"))
    kept = F.expr(
        "filter(lines, (line, i) -> (i div 64) >= size(dense) or "
        "(shiftrightunsigned(dense[cast(i div 64 as int)], cast(i % 64 as int)) & 1L) = 1L)"
    )
    whole = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    lost = joined.filter(F.col("keep").isNotNull()).withColumn("dense", dense).withColumn("lines", lines)
    lost = lost.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    lost = lost.select("row", F.array_join("kept", "\n").alias("kept_text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
    intact = joined.filter(F.col("keep").isNull()).select(
        "row", whole.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")
    )
    added = ("n_lines", "n_dropped", "kept_text")
    return lost.unionByName(intact).select("row.*", *[F.col(c).alias(n) for c, n in zip(added, free_names(names, *added))])
