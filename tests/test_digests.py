import pytest
from pyspark.sql import functions as F

from passagebook.operators import digests, indexing


def versions(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    return df.withColumn("content_hash", indexing.content_hash(["text"]))


def content(stored):
    return sorted((r.chunk_id, r.text) for r in stored.rows().collect())


ROWS = [(f"c{i}", f"text {i}") for i in range(3000)]


def test_one_changed_row_reads_one_bucket(spark, tmp_path):
    """Files of all other buckets hold no table any more, and nobody notices."""
    changed = [(c, "new" if c == "c77" else t) for c, t in ROWS]
    index = digests.write(versions(spark, ROWS), str(tmp_path / "index"), buckets=64)
    source = digests.write(versions(spark, changed), str(tmp_path / "source"), buckets=64)
    (bucket,) = [r.node for r in digests.differing(index, source).collect()]
    assert bucket == versions(spark, [("c77", "x")]).select(digests.bucket_of("chunk_id", 64)).first()[0]
    others = [f for f in tmp_path.glob("*/rows/bucket=*/*.parquet") if f.parent.name != f"bucket={bucket}"]
    assert len(others) > 100
    kept = {f: f.read_bytes() for f in others}
    for f in others:
        f.write_bytes(b"no table")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    done = {r.action: (r.n_keys, r.n_buckets) for r in digests.sync(index, source).collect()}
    assert done["update"] == (1, 1) and set(done) == {"update", "unchanged"} and done["unchanged"][0] < 100
    for f, data in kept.items():
        f.write_bytes(data)
    assert content(index) == sorted(changed)
    assert digests.differing(index, source).isEmpty()


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_sync_in_all_directions(spark, tmp_path, buckets):
    steps = [
        ROWS[:200],
        [(c, t.upper() if i % 50 == 0 else t) for i, (c, t) in enumerate(ROWS[20:260])],
        [],
        ROWS[:3],
        ROWS[:3],
    ]
    index = digests.write(versions(spark, steps[0]), str(tmp_path / "index"), buckets=buckets)
    for i, rows in enumerate(steps[1:]):
        source = digests.write(versions(spark, rows), str(tmp_path / f"source{i}"), buckets=buckets)
        before, after = dict(steps[i]), dict(rows)
        done = {r.action: r.n_keys for r in digests.sync(index, source).collect()}
        assert content(index) == sorted(rows)
        assert done.get("insert", 0) == len(after.keys() - before.keys()) and done.get("delete", 0) == len(before.keys() - after.keys())
        assert done.get("update", 0) == sum(after[c] != before[c] for c in after.keys() & before.keys())


def test_a_run_that_stopped_is_made_good(spark, tmp_path):
    """Rows were written, digests were not: the same buckets differ once more."""
    index = digests.write(versions(spark, ROWS[:100]), str(tmp_path / "index"), buckets=8)
    source = digests.write(versions(spark, ROWS[:101]), str(tmp_path / "source"), buckets=8)
    old = spark.createDataFrame(index.tree().collect(), index.tree().schema)
    digests.sync(index, source)
    old.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/tree")
    assert digests.differing(index, source).count() == 1
    digests.sync(index, source)
    assert content(index) == sorted(ROWS[:101])


def test_digests_do_not_hang_on_order_but_on_all_rows(spark, tmp_path):
    one, two = (digests.tree_of(digests.leaves(versions(spark, rows).repartition(n), "chunk_id", "content_hash", 16), 16) for rows, n in ((ROWS, 3), (ROWS[::-1], 7)))
    assert sorted(one.collect()) == sorted(two.collect())
    twice = digests.leaves(versions(spark, ROWS + ROWS[:1]), "chunk_id", "content_hash", 16)
    assert twice.join(one.filter(F.col("level") == 1), ["node", "n", "first", "second"], "left_anti").count() == 1
    with pytest.raises(ValueError):
        digests.differing(digests.Stored(spark, "a", "k", "v", 8, None), digests.Stored(spark, "b", "k", "v", 9, None))
