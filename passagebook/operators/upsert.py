"""Upsert and delete by key, as plain DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagebook.sources.session import materialize


def latest(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """One row per key: the greatest by `order`, then by the whole row.

    An aggregate, not a window, so copies of a hot key shrink before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    ranked = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *others)
    best = df.groupBy(key).agg(F.max(ranked).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


# Winners of a source up to which an upsert broadcasts them; beyond it both sides meet by key.
BROADCAST_ROWS = 100_000


def upsert(
    target: DataFrame,
    source: DataFrame,
    key: str,
    update_columns: Sequence[str] | None = None,
    order: Sequence[Column] | None = None,
    broadcast_rows: int = 0,
) -> DataFrame:
    """Target after the merge: matched rows take the listed columns of the source (all of
    them by default), unmatched source rows are inserted whole.

    Keys of the source must be unique unless `order` says which copy wins; a copy ends the
    job that reads the result. One grouping of the source finds winners and copies, and one
    full outer join merges: both sides are read once. A target bucketed by the key (see
    `sources.tables.write_bucketed`) stays where it lies, only the source is shuffled.

    For a target that is not bucketed and a source known to be small, `broadcast_rows` says up
    to how many winners are broadcast: they are written and counted first, and the target
    then stays in place as well, at the price of a second reading of its keys.
    """
    updates = set(update_columns if update_columns is not None else source.columns) - {key}
    unknown = updates - set(source.columns)
    if unknown:
        raise ValueError(f"source lacks the columns {sorted(unknown)}")
    needed = [c for c in target.columns if c in source.columns and c != key]
    row = F.struct(F.lit(True).alias("_there"), *needed)
    if order is None:
        copies = F.concat(F.lit(f"source has several rows for one {key}; say by `order` which one wins: "), F.col(key).cast("string"))
        best = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.coalesce(copies, F.lit(f"source has several rows without {key}")))).otherwise(F.first(row))
        new = source.groupBy(key).agg(best.alias("_new"))
    else:
        # The greatest by order, then by the whole row, as `latest` has it.
        others = F.struct(*[c for c in source.columns if c != key])
        ranked = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], others.alias("_all"), row.alias("_row"))
        new = source.groupBy(key).agg(F.max(ranked)["_row"].alias("_new"))

    def merged(name: str) -> Column:
        if name == key:
            return F.col(key)
        if name not in needed:
            return F.col(name)
        takes = F.col("_new").isNotNull() if name in updates else F.col("_old").isNull()
        return F.when(takes, F.col(f"_new.{name}").cast(target.schema[name].dataType)).otherwise(F.col(name)).alias(name)

    columns = [merged(c) for c in target.columns]
    old = target.withColumn("_old", F.lit(True))
    if broadcast_rows:
        new = materialize(new, "upsert-source")
        if new.limit(broadcast_rows + 1).count() <= broadcast_rows:
            matched = target.select(key).join(F.broadcast(new.select(key)), key, "left_semi").distinct()
            fresh = new.join(matched, key, "left_anti")
            gone = [F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields if f.name != key]
            fresh = fresh.select(key, *gone, F.lit(None).cast("boolean").alias("_old"), "_new").select(*columns)
            return old.join(F.broadcast(new), key, "left").select(*columns).unionByName(fresh)
    return old.join(new, key, "full_outer").select(*columns)


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Target without the keys. A target bucketed by the key is not shuffled."""
    return target.join(keys.select(key), key, "left_anti")
