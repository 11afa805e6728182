"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagebook.sources.session import Scratch, materialize

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node it reaches.

    In each round every node hands all its larger neighbours to the least node it knows,
    then all its smaller ones: two passes that keep the components and flatten each of them
    to a star in a logarithmic number of rounds. A hub's neighbours are never gathered:
    the least is an aggregate with partial results and is joined back. Each round is
    written to the shared folder.
    """
    with Scratch(edges.sparkSession) as scratch:
        return scratch.keep(_settled(edges))


def _settled(edges: DataFrame) -> DataFrame:
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(ROUNDS):
        # To larger neighbours: a > b always holds here.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        # To smaller neighbours and itself.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        ).distinct()
        now = materialize(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(seen)
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")
