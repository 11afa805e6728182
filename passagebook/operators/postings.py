"""Exact hybrid search: an inverted index of words, cut into blocks that cells bound.

The hybrid score of a chunk weighs its vector score with the share of the query's words it
holds. `ranking.hybrid` scores the 2k nearest chunks only; here the best k of all chunks are
found, also those that the words bring in from further off.

Posting lists are cut by cell of the vector index, and large cells into slices: a block holds
the marks of a word's chunks in one slice of one cell: 32 bits of a hash, which within a slice
name hardly more than one chunk, and what they name too much is scored like the rest. What is known of a query before any block
is read: the kth score among its 2k nearest chunks is a floor; any other chunk scores at most
the last of those by vector. So it must hold so many of the query's words, and then holds one
of all but so many less one of them: only the lists of the rarest are read, and of those only
the blocks in cells whose ball allows enough. The chunks found are scored by vector where they
lie, once for all queries that hit them; only pairs that can reach the floor with as many words
as were hit, and all that were not read, carry their text further and are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagebook.functions.text import keyword_score, word_set
from passagebook.functions.vectors import has_vector, matrix
from passagebook.operators import search
from passagebook.operators.balls import Balls
from passagebook.operators.ranking import HYBRID_DIGITS
from passagebook.sources.session import materialize

# Chunks of a cell whose ids one block may hold.
BLOCK_ROWS = 8192

# Scores are rounded; a chunk is left out only if it is lower by more than that.
_SLACK = 1e-9

# Pairs scored at once.
_PAIRS = 8192


@dataclass(frozen=True)
class Postings:
    """Blocks (term, cell, slice, n, marks), sorted by term; terms (term, df); and the index."""

    blocks: DataFrame
    terms: DataFrame
    balls: Balls


def build(balls: Balls, path: str, content: str = "content", block_rows: int = BLOCK_ROWS) -> Postings:
    """The inverted index of the chunks of a celled index, written under `path`."""
    spark = balls.index.sparkSession
    slices = F.broadcast(
        balls.index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_slices"))  # one row a cell
    )
    placed = balls.index.select("chunk_id", "cell", content).join(slices, "cell").select(
        F.explode(word_set(F.coalesce(content, F.lit("")))).alias("term"), "cell",
        F.pmod(F.xxhash64("chunk_id"), F.col("_slices")).cast("int").alias("slice"), F.hash("chunk_id").alias("mark"),
    )
    grouped = placed.groupBy("term", "cell", "slice").agg(F.count(F.lit(1)).alias("n"), F.collect_list("mark").alias("marks"))
    grouped.repartitionByRange("term", "cell").sortWithinPartitions("term", "cell").write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(grouped.schema).parquet(f"{path}/blocks")
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    terms.write.parquet(f"{path}/terms")
    return Postings(blocks, spark.read.schema(terms.schema).parquet(f"{path}/terms"), balls)


def _bounds(sent):
    """Over queries: what each cell's rows can score at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(None, *sent.value)
        for batch in batches:
            if batch.num_rows:
                bound = balls.bounds(matrix(batch.column("query_vector")))
                offsets = pa.array(np.arange(len(bound) + 1, dtype=np.int32) * bound.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id"), pa.ListArray.from_arrays(offsets, pa.array(bound.ravel()))], ["query_id", "bounds"]
                )

    return run


def _small(queries: DataFrame):
    """Ids, vectors, floors, numbers of words and of those not read, if the queries are few."""
    table = search.first_rows(queries, search.BROADCAST_QUERIES)
    if table.num_rows > search.BROADCAST_QUERIES or table.nbytes > search.BROADCAST_BYTES:
        return None
    numbers = (table.column(c).to_numpy() for c in ("floor", "n_terms", "n_unread"))
    return table.column("query_id").to_pylist(), matrix(table.column("query_vector")), *numbers


def _scored(weights, vectors, asked, n_hit, floor, n_terms, n_unread) -> tuple[np.ndarray, np.ndarray]:
    """Vector scores of pairs, and which of these can reach the floor with the words they hold."""
    near = np.round(np.einsum("nd,nd->n", vectors, asked), search.SCORE_DIGITS) + 0.0
    share = np.minimum(n_hit + n_unread, n_terms) / n_terms
    return near, np.flatnonzero(weights[0] * near + weights[1] * share + 10.0**-HYBRID_DIGITS + _SLACK >= floor)


def _near_lists(sent, weights, content: str):
    """Over chunks, each with the numbers of the queries that hit it: the pairs that can count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, floor, n_terms, n_unread = sent.value
        names = pa.array(ids, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, kept = matrix(batch.column("embedding")), batch.select(["chunk_id", content])
            number, n_hit = (batch.column(c).flatten().to_numpy() for c in ("number", "n_hit"))
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("number")).to_numpy(zero_copy_only=False))
            for at in range(0, len(row), _PAIRS):
                q, r = number[at : at + _PAIRS], row[at : at + _PAIRS]
                near, can = _scored(weights, vectors[r], asked[q], n_hit[at : at + _PAIRS], floor[q], n_terms[q], n_unread[q])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(q[can])), *kept.take(pa.array(r[can])).columns, pa.array(near[can])], ["query_id", "chunk_id", content, "score"]
                )

    return run


def _near_pairs(weights, content: str):
    """The same over pairs, for queries of any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                numbers = (batch.column(c).to_numpy() for c in ("n_hit", "floor", "n_terms", "n_unread"))
                near, can = _scored(weights, matrix(batch.column("embedding")), matrix(batch.column("query_vector")), *numbers)
                kept = batch.select(["query_id", "chunk_id", content]).take(pa.array(can))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(near[can])], ["query_id", "chunk_id", content, "score"])

    return run


def top_k(
    queries: DataFrame, postings: Postings, k: int = 10, keyword_weight: float = 0.3, semantic_weight: float = 0.7,
    columns: Sequence[str] = ("content",), content: str = "content",
) -> tuple[DataFrame, DataFrame]:
    """The k best of all chunks for each query (query_id, query_text, query_vector) by hybrid
    score: (query_id, rank, score, chunk_id, columns), ties to the smaller chunk id; and for
    each query (query_id, n_blocks, n_read): the blocks of its words, and those read."""
    if k < 1 or semantic_weight <= 0 or keyword_weight < 0:
        raise ValueError("k must be at least 1, the semantic weight above 0 and the keyword weight not below")
    index = postings.balls.index
    fits = has_vector(F.col("query_vector")) & (F.size("query_vector") == postings.balls.centres.shape[1])
    asked = materialize(
        queries.filter(fits).select(F.col("query_id").cast("string").alias("query_id"), "query_text", "query_vector"), "hybrid-queries"
    )
    wanted = asked.select("query_id", F.explode(word_set(F.coalesce("query_text", F.lit("")))).alias("term"))

    def weighed(rows: DataFrame) -> DataFrame:
        # Vector scores with the words of chunk and query.
        share = keyword_score(F.coalesce("query_text", F.lit("")), F.coalesce(content, F.lit("")))
        both = F.round(F.lit(semantic_weight) * F.col("score") + F.lit(keyword_weight) * share, HYBRID_DIGITS)
        return rows.select("query_id", "chunk_id", F.col("score").alias("near"), both.alias("score"))

    nearest = search.top_k(asked, index, 2 * k, columns=[content])
    first = materialize(weighed(nearest.join(asked.select("query_id", "query_text"), "query_id")), "hybrid-first")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")))
    # Where there are fewer than 2k near chunks they are all there are.
    floors = ranked.groupBy("query_id").agg(
        F.min(F.when(F.col("rank") == k, F.col("score"))).alias("floor"), F.min("near").alias("last"), F.count(F.lit(1)).alias("n_near")
    ).filter(F.col("n_near") == 2 * k)

    known = wanted.join(postings.terms, "term")
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    by_query = size.join(floors, "query_id")
    need = F.greatest(F.lit(1), F.ceil(F.col("n_terms") * (F.col("floor") - semantic_weight * F.col("last") - _SLACK) / (keyword_weight or 1e-300)))
    sent = index.sparkSession.sparkContext.broadcast((postings.balls.centres, postings.balls.radii, postings.balls.lengths))
    bounds = asked.join(by_query.select("query_id"), "query_id", "left_semi").select("query_id", "query_vector").mapInArrow(
        _bounds(sent), "query_id string, bounds array<double>"
    )
    about = materialize(by_query.withColumn("need", need).join(bounds, "query_id"), "hybrid-floors")

    # Each word of a query by rarity: a chunk with `need` of them holds one of the first.
    by_df = Window.partitionBy("query_id").orderBy("df", "term")
    placed = known.join(about.select("query_id", "need"), "query_id").withColumn("place", F.row_number().over(by_df)).withColumn(
        "n_known", F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    )
    placed = materialize(placed.withColumn("read", F.col("place") <= F.col("n_known") - F.col("need") + 1).select("query_id", "term", "read"), "hybrid-terms")

    directory = postings.blocks.select("term", "cell", "slice").join(placed, "term")
    in_cell = directory.groupBy("query_id", "cell").agg(F.count_distinct("term").alias("most"))
    reach = F.least(F.element_at("bounds", F.col("cell") + 1), F.col("last"))
    best = F.lit(semantic_weight) * reach + F.lit(keyword_weight) * F.col("most") / F.col("n_terms")
    open_cells = in_cell.join(about, "query_id").filter((F.col("most") >= F.col("need")) & (best + _SLACK >= F.col("floor"))).select("query_id", "cell")
    open_blocks = materialize(directory.filter("read").join(open_cells, ["query_id", "cell"]).select("query_id", "term", "cell", "slice"), "hybrid-blocks")

    # One shuffle: a chunk's hits lie together by its cell and mark, and there it meets all of them.
    hits = (
        postings.blocks.join(open_blocks, ["term", "cell", "slice"]).select("query_id", "cell", F.explode("marks").alias("mark"))
        .repartition("cell", "mark").groupBy("query_id", "cell", "mark").agg(F.count(F.lit(1)).alias("n_hit"))
    )
    rows = index.select("cell", F.hash("chunk_id").alias("mark"), "chunk_id", "embedding", content)
    # What a chunk holds of the words not read is not known: as many as there are. A mark that
    # names several chunks counts too much, never too little.
    unread = placed.groupBy("query_id").agg(F.count_if(~F.col("read")).alias("n_unread"))
    limits = about.select("query_id", "floor", "n_terms").join(unread, "query_id")
    weights = (semantic_weight, keyword_weight)
    small = _small(asked.select("query_id", "query_vector").join(limits, "query_id"))
    if small is None:
        pairs = hits.join(rows, ["cell", "mark"]).join(asked.select("query_id", "query_vector"), "query_id").join(limits, "query_id")
        near = pairs.mapInArrow(_near_pairs(weights, content), f"query_id string, chunk_id string, `{content}` string, score double")
    else:
        sent = index.sparkSession.sparkContext.broadcast(small)
        number = F.broadcast(index.sparkSession.createDataFrame([(q, i) for i, q in enumerate(small[0])], "query_id string, number int"))
        lists = hits.join(number, "query_id").groupBy("cell", "mark").agg(F.collect_list(F.struct("number", "n_hit")).alias("hits"))
        met = rows.join(lists, ["cell", "mark"]).select("chunk_id", content, "embedding", "hits.number", "hits.n_hit")
        near = met.mapInArrow(_near_lists(sent, weights, content), f"query_id string, chunk_id string, `{content}` string, score double")
    pairs = near.join(first.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(asked.select("query_id", "query_text"), "query_id")
    more = weighed(pairs)
    found = search._final(first.unionByName(more).select("query_id", "score", "chunk_id"), k)

    everything = postings.blocks.select("term").join(known, "term").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    read = open_blocks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_read"))
    counts = everything.join(read, "query_id", "left").select("query_id", "n_blocks", F.coalesce("n_read", F.lit(0)).cast("bigint").alias("n_read"))
    return search.fetch(found, index, columns), counts
