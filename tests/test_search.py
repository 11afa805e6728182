import numpy as np
import pytest
from pyspark.sql import functions as F

from passagebook.functions.models import HashedWords, WordOverlap
from passagebook.operators import indexing, ranking, search
from passagebook.plans import retrieval
from passagebook.settings import Settings


def brute(queries, index, k):
    """Every pair scored and sorted, on plain lists."""
    out = []
    for qid, q in queries:
        scored = [(round(float(np.dot(np.float64(q), np.float64(v))), 6), c) for c, v in index]
        scored.sort(key=lambda s: (-s[0], s[1]))
        out += [(qid, i + 1, s, c) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    """A third of the index is one vector, so most places in a ranking are ties."""
    rng = np.random.default_rng(7)

    def units(n):
        v = rng.normal(size=(n, 8))
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()

    vectors = units(400)
    vectors += [vectors[0]] * 200
    index = [(f"c{i * 7919 % 1000:04d}", v) for i, v in enumerate(vectors)]
    queries = [(f"q{i}", v) for i, v in enumerate(units(30) + [vectors[0]])]
    index_df = spark.createDataFrame(
        [(c, v, i % 3) for i, (c, v) in enumerate(index)], "chunk_id string, embedding array<float>, kind int"
    ).repartition(5)
    query_df = spark.createDataFrame(queries, "query_id string, query_vector array<float>")
    return queries, index, query_df, index_df


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "score", "chunk_id").collect())


@pytest.mark.parametrize("k", [1, 5, 250, 700])
def test_broadcast_equals_brute(data, k):
    queries, index, query_df, index_df = data
    assert rows(search.top_k(query_df, index_df, k, columns=[])) == brute(queries, index, k)


@pytest.mark.parametrize("strip,rows_per_slice", [(1024, 50_000), (4, 50), (1, 7)])
def test_grouped_equals_brute(data, monkeypatch, strip, rows_per_slice):
    queries, index, query_df, index_df = data
    monkeypatch.setattr(search, "_STRIP", strip)
    monkeypatch.setattr(search, "INDEX_SLICE", rows_per_slice)
    monkeypatch.setattr(search, "EXACT_CELLS", 3)
    assert rows(search.top_k(query_df, index_df, 12, columns=[], broadcast_queries=3)) == brute(queries, index, 12)


@pytest.mark.parametrize("limit", [4096, 0])
def test_floor_from_sample_changes_nothing(data, limit):
    queries, index, query_df, index_df = data
    got = search.top_k(query_df, index_df, 5, columns=[], broadcast_queries=limit, sample=0.2)
    assert rows(got) == brute(queries, index, 5)
    # A sample with fewer than k rows gives no floor.
    few = search.top_k(query_df, index_df, 500, columns=[], broadcast_queries=limit, sample=0.2)
    assert rows(few) == brute(queries, index, 500)


def test_small_memory_limits(data, monkeypatch):
    queries, index, query_df, index_df = data
    best = search._Best(np.array([q for q, _ in queries], dtype=object), np.float64([v for _, v in queries]), 9, np.full(len(queries), -np.inf))
    monkeypatch.setattr(search, "_STRIP", 16)
    monkeypatch.setattr(search, "_CANDIDATES", 10)
    for part in range(0, len(index), 100):
        ids, vectors = zip(*index[part : part + 100])
        best.add(np.array(ids, dtype=object), np.float64(vectors))
    got = [r for b in best.batches() for r in b.to_pylist()]
    want = {(q, s, c) for q, _, s, c in brute(queries, index, 9)}
    assert {(r["query_id"], r["score"], r["chunk_id"]) for r in got} == want


def test_cells_hot_and_all_probed(data, monkeypatch):
    queries, index, query_df, index_df = data
    monkeypatch.setattr(search, "INDEX_SLICE", 20)
    centroids = indexing.train_cells(index_df, 4)
    celled = search.assign_cells(index_df, centroids)
    got = search.top_k_cells(query_df, celled, centroids, 12, probes=4, columns=[])
    assert rows(got) == brute(queries, index, 12)
    some = rows(search.top_k_cells(query_df, celled, centroids, 12, probes=1, columns=[]))
    assert 0 < len(some) <= 12 * len(queries)


def test_cells_written_and_pruned(spark, data, tmp_path):
    queries, index, query_df, index_df = data
    centroids = indexing.train_cells(index_df, 4)
    stored = search.write_cells(search.assign_cells(index_df, centroids), str(tmp_path / "cells"))
    assert stored.count() == len(index)
    got = search.top_k_cells(query_df, stored, centroids, 12, probes=4, columns=[])
    assert rows(got) == brute(queries, index, 12)


def test_only_probed_cells_are_read(spark, data, tmp_path):
    queries, index, query_df, index_df = data
    centroids = indexing.train_cells(index_df, 20)
    stored = search.write_cells(search.assign_cells(index_df, centroids), str(tmp_path / "cells"))
    one = query_df.filter("query_id = 'q0'")
    cell = search.nearest_cells(centroids, F.col("query_vector"), 1)[0]
    wanted = one.select(cell.alias("cell")).first().cell
    members = {r.chunk_id for r in stored.filter(F.col("cell") == wanted).collect()}
    kept = [(c, v) for c, v in index if c in members]
    others = [f for f in (tmp_path / "cells").glob("cell=*/*.parquet") if f.parent.name != f"cell={wanted}"]
    assert len({f.parent for f in others}) > 10
    for file in others:  # reading one of these would end the search
        file.write_bytes(b"no table")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert rows(search.top_k_cells(one, stored, centroids, 12, probes=1, columns=[])) == brute(queries[:1], kept, 12)
    with pytest.raises(Exception, match="parquet|FAILED_READ_FILE"):
        search.top_k_cells(one, stored, centroids, 12, probes=20, columns=[]).collect()


def test_nearest_cell_is_the_first_of_equals(spark, data):
    _, _, _, index_df = data
    centroids = np.array([[1.0] * 8, [0.5] * 8, [1.0] * 8])
    many = index_df.select(
        search.nearest_cells(centroids, F.col("embedding"), 1)[0].alias("one"),
        search.nearest_cells(centroids, F.col("embedding"), 3)[0].alias("first"),
    )
    assert many.filter("one <> first").count() == 0 and many.filter("one = 2").count() == 0


@pytest.mark.parametrize("limit", [4096, 0])
def test_unsound_vectors_are_never_found(spark, data, limit):
    queries, index, query_df, index_df = data
    bad = [("a-nan", [float("nan")] * 8, 0), ("a-inf", [float("inf")] + [0.0] * 7, 0), ("a-null", None, 0)]
    more = index_df.unionByName(spark.createDataFrame(bad, index_df.schema))
    lost = spark.createDataFrame([("q-nan", [float("nan")] * 8), ("q-null", None)], query_df.schema)
    got = search.top_k(query_df.unionByName(lost), more, 5, columns=[], broadcast_queries=limit)
    assert rows(got) == brute(queries, index, 5)


def test_wrong_dimension(spark, data):
    """A row of another length is passed over; queries of different lengths are an error."""
    _, _, query_df, index_df = data
    short = spark.createDataFrame([("s", [1.0, 0.0], 0)], index_df.schema)
    mixed = index_df.unionByName(short)
    for limit in (4096, 0):
        got, want = (search.top_k(query_df, rows, 3, columns=[], broadcast_queries=limit) for rows in (mixed, index_df))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="vectors differ in length"):
        other = query_df.unionByName(spark.createDataFrame([("qs", [1.0, 0.0])], query_df.schema))
        search.top_k(other, index_df, 3, columns=[]).collect()
    assert indexing.build_index(mixed, columns=["kind"], dim=8).count() == index_df.count()


def test_filters(data):
    queries, index, query_df, index_df = data
    kept = [(c, v) for i, (c, v) in enumerate(index) if i % 3 in (0, 2)]
    got = search.top_k(query_df, index_df, 6, filters={"kind": [0, 2]}, columns=["kind"])
    assert rows(got) == brute(queries, kept, 6)
    one = search.top_k(query_df, index_df, 6, filters={"kind": 1}, columns=["kind"])
    assert {r.kind for r in one.collect()} == {1}


def test_no_queries_no_rows(data):
    _, _, query_df, index_df = data
    assert search.top_k(query_df.limit(0), index_df, 5).isEmpty()
    assert search.top_k(query_df, index_df.filter("kind > 9"), 5).isEmpty()
    with pytest.raises(ValueError):
        search.top_k(query_df, index_df, 0)


def test_plans_have_no_pair_join(data):
    _, _, query_df, index_df = data
    for limit in (4096, 0):
        plan = search.top_k(query_df, index_df, 5, broadcast_queries=limit)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "WindowGroupLimit" in plan


def test_index_rows_are_sent_once(data, monkeypatch):
    """However many queries there are: a group holds index rows and lets queries pass."""
    queries, index, query_df, index_df = data
    monkeypatch.setattr(search, "EXACT_CELLS", 3)
    cells = index_df.withColumn("cell", F.lit(0))
    many = query_df.crossJoin(query_df.sparkSession.range(20)).select("query_id", "query_vector", F.lit(0).alias("cell"), F.lit(0.0).alias("floor"))
    together = search._in_slices(many, cells, "embedding", 100)
    assert together.filter("_side = 0").count() == len(index)
    assert together.select("_slice").distinct().count() == len(index) // 100


def test_search_does_not_read_what_it_only_returns(spark, sf):
    from passagebook.plans import inputs

    stored = inputs.text_index(spark, sf)
    found = search.top_k(retrieval.text_query_vectors(spark, sf), stored, 5)
    (path,) = {f.rsplit("/", 1)[0] for f in found.inputFiles() if "/found-" in f}
    (search_plan,) = [line for line in search.top_k(retrieval.text_query_vectors(spark, sf), stored, 5, columns=[])._jdf.queryExecution().executedPlan().toString().splitlines() if "text-index" in line]
    assert "ReadSchema: struct<chunk_id:string,embedding:array<float>>" in search_plan
    assert set(spark.read.parquet(path).columns) == {"query_id", "rank", "score", "chunk_id"}


def results_frame(spark, rows):
    return spark.createDataFrame(
        rows, "query_id string, rank int, score double, chunk_id string, content string, document_id string"
    )


def test_keyword_cases(spark):
    from passagebook.functions.text import keyword_score

    df = spark.createDataFrame([("The the cat", "a CAT sat"), (" ", "x")], "q string, c string")
    got = [r[0] for r in df.select(keyword_score(F.col("q"), F.col("c"))).collect()]
    assert got == [0.5, 0.0]


def test_hybrid_tie_keeps_vector_order(spark):
    found = results_frame(spark, [("q", 1, 0.5, "z", "x", "d"), ("q", 2, 0.5, "a", "x", "d"), ("q", 3, 0.4, "m", "cat", "d")])
    queries = spark.createDataFrame([("q", "cat")], "query_id string, query_text string")
    got = ranking.hybrid(found, queries, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [("m", 1), ("z", 2)]
    assert got[0].score == pytest.approx(0.7 * 0.4 + 0.3)


def test_threshold_keeps_equal(spark):
    found = results_frame(spark, [("q", 1, 0.7, "a", "x", "d"), ("q", 2, 0.69, "b", "x", "d")])
    assert [r.chunk_id for r in ranking.threshold(found, 0.7).collect()] == ["a"]


class Broken:
    """Fails whenever the query `bad` is in the batch."""

    def score(self, queries, contents):
        if "bad" in queries:
            raise RuntimeError("no service")
        return [float(len(c)) for c in contents]


def test_rerank_failure_keeps_order_of_that_query(spark):
    found = results_frame(spark, [
        ("g", 1, 0.9, "a", "x", "d"), ("g", 2, 0.8, "b", "xxx", "d"),
        ("b", 1, 0.9, "a", "x", "d"), ("b", 2, 0.8, "b", "xxx", "d"),
    ])
    queries = spark.createDataFrame([("g", "good"), ("b", "bad")], "query_id string, query_text string")
    got = ranking.rerank(found, queries, Broken()).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.score) for r in got] == [
        ("b", "a", 0.9), ("b", "b", 0.8), ("g", "b", 3.0), ("g", "a", 1.0),
    ]
    assert WordOverlap().score(["a b", ""], ["b c", ""]) == [0.5, 0.0]


def test_context_budget(spark):
    def pack(lengths, budget):
        rows = [("q", i + 1, 1.0, f"c{i}", "x" * n, f"d{i}") for i, n in enumerate(lengths)]
        return ranking.pack_context(results_frame(spark, rows), budget).first()

    two = pack([40, 40, 400, 4], 20)
    assert two.context == f"[Source: d0]\n{'x' * 40}\n\n---\n\n[Source: d1]\n{'x' * 40}"
    assert [r.chunk_id for r in two.results] == ["c0", "c1"] and two.n_sources == 2
    none = pack([100], 10)
    assert none.context == "" and none.n_sources == 0


def test_settings_zero_is_a_value(spark, data):
    _, _, query_df, index_df = data
    queries = query_df.withColumn("query_text", F.lit("a"))
    index = index_df.withColumn("content", F.lit("b")).withColumn("document_id", F.lit("d"))
    kept = ranking.retrieve(queries, index, Settings(), least=-1.0, use_hybrid=False)
    assert kept.count() == 10 * queries.count()
    assert ranking.retrieve(queries, index, Settings(similarity_threshold=2.0), use_hybrid=False).isEmpty()


def test_vector_or_text_query(spark):
    model = HashedWords(16)
    queries = spark.createDataFrame(
        [("a", "one two", None), ("b", "x", [1.0] + [0.0] * 15)], "query_id string, query_text string, query_vector array<float>"
    )
    got = {r.query_id: r.query_vector for r in search.embed_queries(queries, model).collect()}
    assert got["b"] == [1.0] + [0.0] * 15
    assert got["a"] == pytest.approx(model.embed(["one two"])[0].tolist())


def test_ivf_recall_and_cells_can_fail(spark, sf, monkeypatch):
    found = retrieval.knn_ivf_recall(spark, sf).first()
    assert found.recall_ok and found.n_other_scores == 0
    monkeypatch.setattr(retrieval, "recall_probes", lambda cells: 8)  # finds 0.83 here
    assert not retrieval.knn_ivf_recall(spark, sf).first().recall_ok
    assert all(r.n_without_cell == 0 for r in retrieval.index_cells(spark, sf).collect())
    assign = search.assign_cells
    monkeypatch.setattr(search, "assign_cells", lambda *a: assign(*a).withColumn("cell", F.col("cell") * 0))
    assert sum(r.n_without_cell for r in retrieval.index_cells(spark, sf).collect()) > 0


def test_packs_bound_what_is_sent():
    """As many packs as memory asks for, enough groups, and few copies of the larger side."""
    for queries, rows in [(300_000, 22_000_000), (600_000, 600_000), (5_000, 400_000), (10_000, 10), (0, 0)]:
        packs, blocks = search._packs(queries, rows, search.EXACT_CELLS)
        assert packs * blocks >= search.GROUPS and rows <= packs * 2 * search.INDEX_SLICE
        assert blocks == 1 or packs * queries + blocks * rows < search.GROUPS * queries + rows or queries == 0 or rows < queries


def test_screened_scores_are_exact(spark):
    """Rows closer to each other than 32 bits tell apart, lengths far from 1, and too long ones."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=48)
    vectors = [*(base + rng.normal(size=(300, 48)) * 1e-6), *(rng.normal(size=(300, 48)) * 10.0 ** rng.integers(-4, 3, size=(300, 1)))]
    ids = [f"c{i:04d}" for i in range(len(vectors))]
    queries = [base, *rng.normal(size=(5, 48)), base * 1e-3]
    names = [f"q{i}" for i in range(len(queries))]
    for more, kind in (([], search._Nearest), ([base * 1e18], search._Nearest)):
        index = vectors + more
        best = kind(np.array(names, object), np.float64(queries), 7, np.full(len(queries), -np.inf))
        for at in range(0, len(index), 97):
            part = index[at : at + 97]
            best.add(np.array((ids + ["far"])[at : at + len(part)], object), np.float64(part))
        got = sorted((r["query_id"], r["score"], r["chunk_id"]) for b in best.batches() for r in b.to_pylist())
        want = []
        for name, q in zip(names, queries):
            scored = sorted((-round(float(np.dot(q, v)), 6), c) for c, v in zip(ids + ["far"], index))
            want += [(name, -s + 0.0, c) for s, c in scored[:7]]
        assert [(q, c) for q, _, c in got] == [(q, c) for q, _, c in sorted(want)]
        np.testing.assert_allclose([s for _, s, _ in got], [s for _, s, _ in sorted(want)], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("probes", [20, 12])
def test_a_query_goes_once_to_a_pack_of_cells(data, monkeypatch, probes):
    """However many of its cells it wants: it found k rows in each of them before."""
    queries, index, query_df, index_df = data
    sent, final = [], search._final
    monkeypatch.setattr(search, "GROUPS", 1, raising=False)
    monkeypatch.setattr(search, "_final", lambda partial, k: final(sent.append(partial) or partial, k))
    centroids = indexing.train_cells(index_df, 20)
    celled = search.assign_cells(index_df, centroids)
    got = rows(search.top_k_cells(query_df, celled, centroids, 5, probes=probes, columns=[]))
    assert sent[0].count() <= 5 * len(queries)
    # The rows are those of the nearest cells, and no others.
    cells = {r.chunk_id: r.cell for r in celled.collect()}
    for q, v in queries:
        near = set(np.argsort(-(centroids @ np.float64(v) - (centroids**2).sum(axis=1) / 2), kind="stable")[:probes].tolist())
        kept = [(c, w) for c, w in index if cells[c] in near]
        assert [r for r in got if r[0] == q] == brute([(q, v)], kept, 5)


def test_many_cells_start_from_the_sample(data, monkeypatch):
    """The other start is made on the driver, in work that grows with the square of the cells."""
    _, _, _, index_df = data
    seen, kmeans = [], indexing.KMeans
    monkeypatch.setattr(indexing, "KMeans", lambda **options: seen.append(options.get("initMode")) or kmeans(**options))
    monkeypatch.setattr(indexing, "SPREAD_CELLS", 10, raising=False)
    assert len(indexing.train_cells(index_df, 10)) == 10 and len(indexing.train_cells(index_df, 11)) == 11
    assert seen == ["k-means||", "random"]


def _bags(n, seed):
    """Bags of words scaled to length 1, in 32 bits: most short, one in forty with words said over and over."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(10, 74)
    bags = np.stack([rng.multinomial(rng.integers(3, 60), share / share.sum()) for _ in range(n)]).astype(np.float64)
    bags[::40, :3] *= 30
    bags[::17] *= 2
    return (bags / np.sqrt((bags * bags).sum(axis=1, keepdims=True))).astype(np.float32)


def test_whole_numbers_are_met_several_at_once(monkeypatch):
    """Bags of words are not scored pair by pair, but for those that may be found; vectors of other
    kinds among them, and queries without a floor, are. The rows are those of a plain search."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows, asked, k = _bags(3000, 1), _bags(200, 2).astype(np.float64), 6
    rows[7], rows[8], rows[9], rows[500] = rng.normal(size=64), np.nan, 0, rows[501]
    asked[3], asked[4], asked[5] = rng.normal(size=64), np.inf, 0
    ids, names = [f"c{i * 7919 % 10007:05d}" for i in range(len(rows))], np.array([f"q{i}" for i in range(len(asked))], object)
    sound = np.isfinite(rows).all(axis=1)
    finite = np.isfinite(asked).all(axis=1)
    scores = np.full((len(asked), len(rows)), -np.inf)
    scores[np.ix_(finite, sound)] = np.round(asked[finite] @ rows[sound].astype(np.float64).T, search.SCORE_DIGITS) + 0.0
    floors = np.where(finite, np.sort(scores, axis=1)[:, -8], -np.inf)
    floors[[0, 1]] = -np.inf, 2.0
    want = []
    for i in np.flatnonzero(finite):
        best = sorted((-scores[i, j], ids[j]) for j in np.flatnonzero(sound & (scores[i] >= floors[i])))[:k]
        want += [(names[i], c, -s) for s, c in best]
    pairs, strip = [], search._Nearest._strip
    monkeypatch.setattr(search._Nearest, "_strip", lambda self, v, only: pairs.append(len(v) * len(self.queries if only is None else only)) or strip(self, v, only))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows.tolist(), pa.list_(pa.float32()))], ["chunk_id", "embedding"])
    held = search._held_vectors([batch.slice(0, 1000), batch.slice(1000)])
    got = [r for b in search._best_of(k)(0, held, names, asked, floors) for r in b.to_pylist()]
    assert sorted((r["query_id"], r["chunk_id"]) for r in got) == sorted((q, c) for q, c, _ in want)
    scored = {(r["query_id"], r["chunk_id"]): r["score"] for r in got}
    assert all(abs(scored[q, c] - s) < 1e-9 for q, c, s in want)
    assert sum(pairs) < 0.1 * len(rows) * len(asked)


@pytest.mark.parametrize("divisor", [1, 2, 3, 7])
def test_counts_are_the_vectors(divisor):
    """Whatever count the least value stands for; what is not whole numbers is not taken for it."""
    bags = np.array([[divisor, 2 * divisor + 1, 0, 5 * divisor], [0, 0, 0, 0], [300.0, 1, 0, 0], [1, -1, 0, 2], [1, 2, np.nan, 0]])
    counts = search._Counts(bags / 17)
    assert counts.fits.tolist() == [divisor < 4, True, False, False, False]
    kept = counts.numbers[counts.fits] * counts.units[counts.fits][:, None]
    np.testing.assert_allclose(kept, bags[counts.fits] / 17, atol=1e-12)


@pytest.mark.parametrize("least", [None, 0.4])
def test_floors_from_samples_of_samples(data, monkeypatch, least):
    """A large index gives its floors by a sample, whose own come from a smaller one."""
    queries, index, query_df, index_df = data
    monkeypatch.setattr(search, "FLOOR_ROWS", 40, raising=False)
    monkeypatch.setattr(search, "FLOOR_SHARE", 1 / 3)
    sizes, count = [], search._packs
    monkeypatch.setattr(search, "_packs", lambda asked, rows, most: sizes.append(rows) or count(asked, rows, most))
    options = {} if least is None else {"least": least}
    got = rows(search.top_k(query_df, index_df, 12, columns=[], broadcast_queries=3, **options))
    assert got == [r for r in brute(queries, index, 12) if least is None or r[2] >= least]
    assert len(sizes) > 2 and sizes == sorted(sizes) and sizes[0] <= 40


def test_results_need_no_rows_below_the_threshold(spark, monkeypatch):
    """The hybrid threshold bounds the vector score from below; results and their ranks stay."""
    embedder, settings = HashedWords(64), Settings(similarity_threshold=0.6)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words, rng.integers(2, 12))) for _ in range(150)]
    vectors = embedder.embed(texts).tolist()
    index = spark.createDataFrame([(f"c{i:03d}", t, "d", v) for i, (t, v) in enumerate(zip(texts, vectors))], "chunk_id string, content string, document_id string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", t, v) for i, (t, v) in enumerate(zip(texts[:40:2], vectors[:40:2]))], "query_id string, query_text string, query_vector array<float>")
    asked, plain = [], search.top_k
    monkeypatch.setattr(ranking, "top_k", lambda *a, **b: asked.append(b.pop("least", None)) or plain(*a, **b))
    want = ranking.retrieve(queries, index, settings).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ranking, "top_k", plain)
    got = ranking.retrieve(queries, index, settings).orderBy("query_id", "rank").collect()
    assert got == want and len(got) > 20
    assert 0.428 < asked[0] < 3 / 7
    assert ranking._vector_floor(0.6, 0.3, 0.0) is None and ranking._vector_floor(0.5, -1.0, 0.5) < 1.0
