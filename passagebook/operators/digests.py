"""Keeping an index up to its source by a tree of hashes.

Rows lie in buckets of their key, a folder each. The digest of a bucket is the number of its
rows and two sums of hashes of key and version, so it does not depend on their order, and
digests of buckets add up to that of the node above them; a node has FANOUT nodes below it,
and the root stands for the table. Two tables are compared from the root down: only nodes
that differ are followed, and only buckets that differ are read. The digests are a small
table beside the rows, so equal tables cost a comparison of two rows.

The digests of an index are written after its rows. A run that stops between the two leaves
digests that differ from the source, and the next run takes the same buckets again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagebook.operators.indexing import apply_sync, key_difference
from passagebook.sources.session import materialize

BUCKETS = 4096
FANOUT = 16

_SUM = "decimal(38,0)"


@dataclass(frozen=True)
class Stored:
    """A table in buckets: rows under `path`/rows, the tree (level, node, n, first, second)
    under `path`/tree; level 0 is the root."""

    spark: SparkSession
    path: str
    key: str
    version: str
    buckets: int
    schema: T.StructType

    def rows(self) -> DataFrame:
        """All rows. The folder of a bucket that has lost its last row is left where it is and not read."""
        held = self.tree().filter((F.col("level") == _depth(self.buckets)) & (F.col("n") > 0)).select(F.col("node").alias("bucket"))
        return self.all_rows().join(F.broadcast(held), "bucket", "left_semi")

    def all_rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def tree(self) -> DataFrame:
        return self.spark.read.schema(f"level int, node int, n long, first {_SUM}, second {_SUM}").parquet(f"{self.path}/tree")

    def only(self, buckets: list[int]) -> DataFrame:
        return self.rows().filter(F.col("bucket").isin(buckets))


def _depth(buckets: int) -> int:
    depth, width = 0, 1
    while width < buckets:
        depth, width = depth + 1, width * FANOUT
    return depth


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def leaves(rows: DataFrame, key: str, version: str, buckets: int) -> DataFrame:
    """(node, n, first, second) of the buckets that have rows."""
    return rows.groupBy(bucket_of(key, buckets).alias("node")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(key, version).cast(_SUM)).cast(_SUM).alias("first"),
        F.sum(F.xxhash64(F.lit("second"), version, key).cast(_SUM)).cast(_SUM).alias("second"),
    )


def tree_of(bottom: DataFrame, buckets: int) -> DataFrame:
    """All levels above and with the leaves, in one grouping of them: there are `buckets` at most."""
    depth = _depth(buckets)
    levels = F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.floor(F.col("node") / FANOUT ** (depth - level)).cast("int").alias("node")) for level in range(depth + 1)
    ]))
    return bottom.select(levels.alias("at"), "n", "first", "second").groupBy("at.level", "at.node").agg(
        F.sum("n").alias("n"), F.sum("first").cast(_SUM).alias("first"), F.sum("second").cast(_SUM).alias("second")
    )


def write(rows: DataFrame, path: str, key: str = "chunk_id", version: str = "content_hash", buckets: int = BUCKETS) -> Stored:
    """Store rows in buckets with their tree. Buckets are rebalanced, so a large one has several files."""
    rows = rows.withColumn("bucket", bucket_of(key, buckets))
    stored = Stored(rows.sparkSession, path, key, version, buckets, rows.schema)
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    kept = stored.all_rows().select(key, version)
    tree_of(leaves(kept, key, version, buckets), buckets).coalesce(1).write.parquet(f"{path}/tree")
    return stored


def differing(one: Stored, other: Stored) -> DataFrame:
    """(node): the buckets whose digests differ, found from the root down."""
    if (one.key, one.version, one.buckets) != (other.key, other.version, other.buckets):
        raise ValueError("the tables are not in the same buckets")
    same = ["level", "node"]
    nothing = [F.lit(0).cast(t) for t in ("long", _SUM, _SUM)]

    def level_of(stored: Stored, level: int, names: list[str]) -> DataFrame:
        rows = stored.tree().filter(F.col("level") == level)
        return rows.select(*same, *[F.col(c).alias(n) for c, n in zip(("n", "first", "second"), names)])

    open_nodes = None
    for level in range(_depth(one.buckets) + 1):
        both = level_of(one, level, ["n1", "f1", "s1"]).join(level_of(other, level, ["n2", "f2", "s2"]), same, "full_outer")
        if open_nodes is not None:
            above = open_nodes.select(F.col("node").alias("_above"))
            both = both.join(above, F.floor(F.col("node") / FANOUT).cast("int") == F.col("_above"), "left_semi")
        unequal = [~F.coalesce(a, z).eqNullSafe(F.coalesce(b, z)) for a, b, z in zip(map(F.col, ("n1", "f1", "s1")), map(F.col, ("n2", "f2", "s2")), nothing)]
        open_nodes = materialize(both.filter(unequal[0] | unequal[1] | unequal[2]).select("node"), "open-nodes")
        if open_nodes.isEmpty():
            break
    return open_nodes


def sync(index: Stored, source: Stored) -> DataFrame:
    """Bring an index up to its source and say what was done: (action, n_keys, n_buckets) for
    insert, update, delete and unchanged, over the rows of the buckets that differed."""
    nodes = differing(index, source).toArrow().column("node").to_pylist()  # one number a bucket
    old, new = index.only(nodes), source.only(nodes)
    done = key_difference(old, new, index.key, index.version).groupBy("action").agg(F.count(F.lit(1)).alias("n_keys"))
    done = materialize(done.withColumn("n_buckets", F.lit(len(nodes))), "sync-done")
    if nodes:
        columns = index.all_rows().columns
        merged = materialize(apply_sync(old, new.select(*columns), index.key), "sync-rows")
        writer = merged.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{index.path}/rows")
        bottom = index.tree().filter((F.col("level") == _depth(index.buckets)) & ~F.col("node").isin(nodes)).select("node", "n", "first", "second")
        bottom = bottom.unionByName(leaves(merged, index.key, index.version, index.buckets))
        tree = materialize(tree_of(bottom, index.buckets), "sync-tree")
        tree.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/tree")
    return done
