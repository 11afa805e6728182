"""Ledgers, profiles and neighbourhoods that read only what is new."""

import random

import pytest
from pyspark.sql import functions as F

from passagebook.operators import graph, ledger, sketches


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id string")


@pytest.mark.parametrize("most_new", [10**6, 3])
def test_ledger_equals_an_anti_join(spark, tmp_path, monkeypatch, most_new):
    monkeypatch.setattr(ledger, "IDS_PER_FILTER", 70)
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(f"d{i}", i) for i in range(0, 900, 7)] + [(None, -1), ("d7", -2)], "transcription_id string, n int")
    assert ledger.unseen(rows, path).count() == rows.count()  # no run yet
    for run in range(5):
        ledger.add(frame(spark, [f"d{i}" for i in range(run, 600, 5)] + [None, f"d{run}"]), path, f"r{run}")
    got = sorted((str(r.transcription_id), r.n) for r in ledger.unseen(rows, path, most_new=most_new).collect())
    assert got == sorted((str(r.transcription_id), r.n) for r in rows.collect() if r.transcription_id is None or int(r.transcription_id[1:]) >= 600)
    ledger.add(frame(spark, ["d3"]), path, "r0")  # again: replaces itself
    assert ledger.processed(frame(spark, ["d5"]), path).filter("document_id = 'd5'").isEmpty()


def test_parts_without_a_possible_match_are_not_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for run in range(6):
        ledger.add(frame(spark, [f"run {run} id {i}" for i in range(500)]), path, f"r{run}")
    for file in (tmp_path / "ledger" / "ids").glob("part=r[0-35]/*.parquet"):
        file.write_bytes(b"no table")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    rows = frame(spark, ["run 4 id 9", "run 4 id 499", "new"])
    assert [r.part for r in ledger.possible_parts(rows, path, "document_id").collect()] == ["r4"]
    assert [r.document_id for r in ledger.unseen(rows, path, "document_id").collect()] == ["new"]


def test_filters_hold_every_id_and_few_others(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.add(frame(spark, [f"a{i}" for i in range(3000)]), path, "one")
    hits = [not ledger.possible_parts(frame(spark, [f"{kind}{i}"]), path, "document_id").isEmpty() for kind in "ab" for i in range(8)]
    assert all(hits[:8]) and sum(hits[8:]) <= 1


def numbers(spark, values):
    return spark.createDataFrame([(f"id{v % 700}", None if v % 11 == 0 else float(v)) for v in values], "id string, v double")


def counts():
    return {"n_even": F.col("v") % 2 == 0, "total": F.col("v")}


def of(rows, part):
    return sketches.profile(rows, part, counts(), ["id"], {"v": F.col("v")})


def test_report_on_parts_equals_report_on_all(spark, tmp_path):
    """Counts exactly; distinct ids and quantiles within the bounds of their sketches, in
    whichever order the parts came. Only the new part is read for an append."""
    values = list(range(6000))
    random.Random(5).shuffle(values)
    path = str(tmp_path / "profiles")
    for i, cut in enumerate((values[:3000], values[3000:3001], values[3001:5000], values[5000:])):
        of(numbers(spark, cut), f"p{i}").write.mode("append").parquet(path)
    got = sketches.report(spark.read.parquet(path), (0.1, 0.5, 0.9)).first()
    whole = sketches.report(of(numbers(spark, values), "all"), (0.1, 0.5, 0.9)).first()
    exact = numbers(spark, values).agg(F.count("*"), *[F.sum(c.cast("long")) for c in counts().values()]).first()
    assert (got.n_rows, got.n_even, got.total) == (whole.n_rows, whole.n_even, whole.total) == tuple(exact)
    assert abs(got.n_id / 700 - 1) < 0.05 and abs(whole.n_id / 700 - 1) < 0.05
    kept = sorted(v for v in values if v % 11)
    for rank in (0.1, 0.5, 0.9):
        for one in (got, whole):
            at = sum(k <= one[f"v_p{round(100 * rank)}"] for k in kept) / len(kept)
            assert abs(at - rank) < 0.02


def test_report_of_nothing_and_of_nulls(spark, tmp_path):
    empty = sketches.report(of(numbers(spark, []), "none")).first()
    assert (empty.n_rows, empty.n_even, empty.total, empty.n_id, empty.v_p50) == (0, 0, 0, 0, None)
    nulls = spark.createDataFrame([(None, None)] * 3, "id string, v double")
    both = of(nulls, "nulls").unionByName(of(numbers(spark, [2]), "one"))
    found = sketches.report(both).first()
    assert (found.n_rows, found.n_even, found.n_id, found.v_p50) == (4, 1, 1, 2.0)


def plain_hops(edges, seeds, hops):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for seed in seeds:
        seen, front = {seed: 0}, {seed}
        for hop in range(1, hops + 1):
            front = {n for f in front for n in near.get(f, ())} - set(seen)
            seen.update(dict.fromkeys(front, hop))
        out.update({(seed, node): hop for node, hop in seen.items()})
    return out


@pytest.mark.parametrize("hops", [0, 1, 4])
def test_hops_of_many_seeds(spark, hops):
    """More seeds than a block holds, a hub, loops, repeated edges and seeds without edges."""
    rng = random.Random(hops)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(250)] + [("hub", f"n{i}") for i in range(0, 300, 3)]
    edges += [("n1", "n1"), edges[0], edges[0]]
    seeds = [f"n{i}" for i in range(0, 300, 2)] + ["alone", "alone"]
    edge_df = spark.createDataFrame(edges, "src string, dst string")
    seed_df = spark.createDataFrame([(s,) for s in seeds], "node string")
    want = plain_hops(edges, set(seeds), hops)
    got = graph.k_hop_many(edge_df, seed_df, hops).collect()
    assert {(r.seed, r.node): r.hop for r in got} == want and len(got) == len(want)
    least = {}
    for (_, node), hop in want.items():
        least[node] = min(hop, least.get(node, 99))
    any_seed = graph.k_hop(edge_df, seed_df, hops).collect()
    assert {r.node: r.hop for r in any_seed} == least and len(any_seed) == len(least)


def test_a_large_source_lands_in_several_files(spark, sf, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from passagebook.plans import ingestion

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.lit("one"))
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(ingestion, "scratch_path", lambda *_: str(tmp_path / "landing"))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, "50k")
    try:
        got = ingestion.file_inventory(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(name)
    assert len(got) == 1 and got[0].n_documents == docs.count()
    assert len(list((tmp_path / "landing" / "source=one").glob("*.txt"))) > 1
