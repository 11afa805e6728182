"""Small graph tables over chunks: mentions, relations, filters, neighbourhoods.

The definitions are our own: nodes are entities with a type and a confidence, edges are
relations with a confidence.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebook.functions.models import Extractor
from passagebook.sources.session import shared_folder

# The types an extractor may give.
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "DATE", "EVENT", "CONCEPT")

# The types that are found without an extractor, by one pattern each. A date is
# a number group like 2024-01-31; a concept is a run of capitalised words.
ENTITY_PATTERNS = {
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "CONCEPT": r"[A-Z][a-z]+(?: [A-Z][a-z]+)*",
}

_SALTS = 16


def _mentions_of(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(ENTITY_PATTERNS[kind]), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("entity_type"), m.alias("entity")))


def mentions(text: Column, extractor: Extractor | None = None) -> Column:
    """The mentions of a text as an array of (entity_type, entity)."""
    if extractor is None:
        return F.concat(*[_mentions_of(kind, text) for kind in ENTITY_PATTERNS])
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("entity", pa.string())]))

    @F.arrow_udf("array<struct<entity_type:string,entity:string>>")
    def extracted(texts: pa.Array) -> pa.Array:
        found = [list(one) for one in extractor.extract([t or "" for t in texts.to_pylist()])]
        if len(found) != len(texts):
            raise ValueError(f"mentions of {len(found)} texts, {len(texts)} were given")
        unknown = {k for one in found for k, _ in one} - set(ENTITY_TYPES)
        if unknown:
            raise ValueError(f"unknown entity types: {sorted(unknown)}")
        return pa.array([[{"entity_type": k, "entity": name} for k, name in one] for one in found], kind)

    return extracted(text)


def entity_mentions(
    chunks: DataFrame, key: str = "chunk_id", text: str = "content", extractor: Extractor | None = None
) -> DataFrame:
    """One row per mention: key, entity type, entity."""
    return chunks.select(key, F.inline(mentions(F.col(text), extractor)))


def relations(chunks: DataFrame, text: str = "content", extractor: Extractor | None = None) -> DataFrame:
    """Entities mentioned in the same chunk, with the number of chunks.

    A chunk pairs its distinct entities. Its pairs are bounded because its size is: the
    input is chunks, not whole documents. The two ends are in order of name; an entity has
    no relation to itself.
    """
    names = F.transform(mentions(F.col(text), extractor), lambda m: m["entity"])
    n = F.size("_m")
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), n - 1),
            lambda i: F.transform(
                F.slice("_m", i + 1, n), lambda other: F.struct(F.element_at("_m", i).alias("src"), other.alias("dst"))
            ),
        )
    )
    return (
        chunks.select(F.array_sort(F.array_distinct(names)).alias("_m"))
        .filter(n > 1)
        .select(F.inline(pairs))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n_times"))
    )


def with_confidence(edges: DataFrame, times: str = "n_times") -> DataFrame:
    """Confidence n / (n + 1): one sighting gives a half, more come close to one."""
    return edges.withColumn("confidence", F.col(times) / (F.col(times) + 1))


def graph_tables(mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables from mentions and relations."""
    nodes = with_confidence(
        mentions.groupBy(F.col("entity").alias("id")).agg(
            F.min("entity_type").alias("group"), F.count(F.lit(1)).alias("n_times")
        )
    ).select("id", F.col("id").alias("label"), "group", "n_times", "confidence")
    return nodes, with_confidence(edges)


def graph_stats(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """One row: nodes, edges, directed density."""
    marks = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(
        edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    counts = marks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_nodes"),
        F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("n_edges"),
    )
    possible = F.col("n_nodes") * (F.col("n_nodes") - 1)
    density = F.when(possible > 0, F.col("n_edges") / possible).otherwise(0.0)
    return counts.withColumn("density", density)


def graph_filter(
    nodes: DataFrame, edges: DataFrame, min_node: float = 0.7, min_edge: float = 0.6
) -> tuple[DataFrame, DataFrame]:
    """Sure nodes, and sure edges between them."""
    sure = nodes.filter(F.col("confidence") >= min_node)
    kept = edges.filter(F.col("confidence") >= min_edge)
    for end in ("src", "dst"):
        kept = kept.join(sure.select(F.col("id").alias(end)), end, "left_semi")
    return sure, kept


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions, those of a node spread over salts, so that a hub is not one
    task; checkpointed in the shared folder."""
    shared_folder(edges.sparkSession)
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst"), F.col("src")))
    return both.withColumn("_salt", F.pmod(F.xxhash64("dst"), F.lit(_SALTS)).cast("int")).checkpoint()


def _salted(front: DataFrame) -> DataFrame:
    return front.withColumnRenamed("node", "src").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """Nodes within `hops` steps of any seed, with the least number of steps.

    Edges are taken in both directions, so a neighbour of a node at some distance is at most
    one step nearer: each step joins the last frontier with its edges and leaves out what the
    last two frontiers hold. Earlier ones are not read again. Every frontier is checkpointed
    in the shared folder, so a lost executor repeats one step only.
    """
    both = _both_ways(edges)
    front = seeds.select("node").distinct().checkpoint()
    before, reached = None, front.withColumn("hop", F.lit(0))
    for step in range(1, hops + 1):
        found = both.join(_salted(front), ["src", "_salt"]).select(F.col("dst").alias("node")).distinct()
        known = front if before is None else front.unionAll(before)
        before, front = front, found.join(known, "node", "left_anti").checkpoint()
        reached = reached.unionByName(front.withColumn("hop", F.lit(step)))
    return reached


def _numbered(seeds: DataFrame) -> DataFrame:
    """(seed, _block, _bit) in the order of the names, shorter ones first: seeds with names close
    to each other share a block, as they often reach the same nodes."""
    named = seeds.select(F.col("node").alias("seed")).distinct().orderBy(F.length("seed"), "seed")
    numbered = named.withColumn("_n", F.monotonically_increasing_id()).checkpoint()
    return numbered.select("seed", F.floor(F.col("_n") / 64).alias("_block"), (F.col("_n") % 64).cast("int").alias("_bit"))


def k_hop_many(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, node, hop): the nodes within `hops` steps of each seed by itself, with the least
    number of steps.

    Seeds go in blocks of 64, one bit each: a node carries, for a block, the bits of the
    seeds that have reached it, and one pass over the edges takes all of them a step on. A
    frontier holds only the bits that are new; as with k_hop the last two tell them.
    """
    both = _both_ways(edges)
    numbered = _numbered(seeds)
    key = ["node", "_block"]
    front = numbered.select(F.col("seed").alias("node"), "_block", F.expr("shiftleft(1L, _bit)").alias("_bits")).checkpoint()
    before, steps = None, [front.withColumn("hop", F.lit(0))]
    for step in range(1, hops + 1):
        found = both.join(_salted(front), ["src", "_salt"]).groupBy(F.col("dst").alias("node"), "_block").agg(F.bit_or("_bits").alias("_bits"))
        known = front if before is None else front.unionByName(before)
        known = known.groupBy(*key).agg(F.bit_or("_bits").alias("_known"))
        new = found.join(known, key, "left").withColumn("_bits", F.expr("_bits & ~coalesce(_known, 0L)")).filter("_bits <> 0")
        before, front = front, new.select(*key, "_bits").checkpoint()
        steps.append(front.withColumn("hop", F.lit(step)))
    whole = reduce(DataFrame.unionByName, steps)
    each = whole.withColumn("_bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)))
    return each.join(numbered.select("seed", "_block", "_bit"), ["_block", "_bit"]).select("seed", "node", "hop")
