import numpy as np
import pytest
from pyspark.sql import functions as F

from passagebook.operators import balls, indexing, quantised, search
from passagebook.plans import retrieval


def brute(queries, index, k):
    out = []
    for qid, q in queries:
        scored = [(round(float(np.dot(np.float64(q), np.float64(v))), 6), c) for c, v in index]
        scored.sort(key=lambda s: (-s[0], s[1]))
        out += [(qid, i + 1, s, c) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "score", "chunk_id").collect())


@pytest.fixture(scope="module")
def clusters(spark):
    """Ten tight clusters, one of them with a third of all rows, and a hot vector."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    own = np.r_[rng.integers(0, 10, 500), np.zeros(250, int)]
    vectors = centres[own] + rng.normal(size=(750, 16)) * 0.1
    vectors = np.r_[vectors, np.repeat(vectors[:1], 60, axis=0)]
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).tolist()
    index = [(f"c{i * 7919 % 1000:04d}", v) for i, v in enumerate(vectors)]
    queries = [(f"q{i}", vectors[i * 11]) for i in range(40)]
    index_df = spark.createDataFrame([(c, v, i % 3) for i, (c, v) in enumerate(index)], "chunk_id string, embedding array<float>, kind int").repartition(5)
    return queries, index, spark.createDataFrame(queries, "query_id string, query_vector array<float>"), index_df


@pytest.fixture(scope="module")
def coded(spark, clusters, tmp_path_factory):
    index_df = clusters[3]
    quantiser = quantised.learn(index_df, cells=20)
    codes = quantised.encode(index_df, quantiser, copies=2, columns=["kind"])
    return quantiser, search.write_cells(codes, str(tmp_path_factory.mktemp("codes") / "codes"))


def test_codes_are_bytes_in_the_nearest_cells(clusters, coded):
    quantiser, codes = coded
    index = dict(clusters[1])
    found = codes.collect()
    assert len(found) == 2 * len(index) and {len(r.code) for r in found} == {8}
    for r in found[::97]:
        v = np.float64(index[r.chunk_id])
        assert r.cell in np.argsort(((quantiser.centroids - v) ** 2).sum(axis=1))[:2]
        left = (v - quantiser.centroids[r.cell]).reshape(8, 2)
        near = [((book - part) ** 2).sum(axis=1) for book, part in zip(quantiser.codebooks, left)]
        assert all(n[c] == pytest.approx(n.min()) for n, c in zip(near, r.code))


def test_looked_up_scores_are_those_of_the_decoded_vectors(coded):
    quantiser, _ = coded
    rng = np.random.default_rng(1)
    queries, codes = rng.normal(size=(6, 16)), rng.integers(0, quantiser.codebooks.shape[1], (9, 8)).astype(np.uint8)
    looked = quantised._Looked(np.arange(6), queries, 3, np.full(6, -np.inf), quantiser, 4).scores(codes)
    decoded = quantiser.centroids[4] + np.stack([np.concatenate([b[c] for b, c in zip(quantiser.codebooks, row)]) for row in codes])
    assert looked == pytest.approx(queries @ decoded.T)


def test_all_cells_and_all_codes_kept_is_exact(clusters, coded):
    queries, index, query_df, index_df = clusters
    quantiser, codes = coded
    got = quantised.top_k(query_df, index_df, codes, quantiser, 12, probes=20, keep=len(index))
    assert rows(got) == brute(queries, index, 12)
    kinds = quantised.top_k(query_df, index_df, codes, quantiser, 12, probes=20, keep=len(index), filters={"kind": 1}, columns=["kind"])
    assert rows(kinds) == brute(queries, [r for i, r in enumerate(index) if i % 3 == 1], 12) and {r.kind for r in kinds.collect()} == {1}


def test_a_tenth_of_the_cells_finds_most(clusters, coded):
    queries, index, query_df, index_df = clusters
    quantiser, codes = coded
    assert quantiser.probes() == 2
    want, got = set(brute(queries, index, 10)), set(rows(quantised.top_k(query_df, index_df, codes, quantiser, 10)))
    assert len({(q, c) for q, _, _, c in want} & {(q, c) for q, _, _, c in got}) >= 0.9 * len(want)


def test_a_query_reads_only_its_cells(spark, clusters, coded):
    quantiser, codes = coded
    one = clusters[2].filter("query_id = 'q3'")
    asked = search.ask_cells(one, quantiser.centroids, quantiser.probes())
    plan = search.only_cells(codes, asked, quantiser.cells)
    plan.collect()
    scan = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 1 <= scan.metrics().apply("numPartitions").value() <= quantiser.cells * quantised.SHARE


def test_fewest_copies(clusters):
    index_df = clusters[3]
    quantiser = quantised.learn(index_df, cells=20)
    assert quantised.choose_copies(index_df, quantiser, target=0.0) == 1
    assert 1 <= quantised.choose_copies(index_df, quantiser, target=0.95) <= quantised.choose_copies(index_df, quantiser, target=1.0) <= 8


def test_unsound_vectors_and_no_rows(spark, clusters, coded, tmp_path):
    queries, index, query_df, index_df = clusters
    quantiser, codes = coded
    bad = [("a", [float("nan")] * 16, 0), ("b", [float("inf")] * 16, 0), ("c", None, 0), ("d", [1.0], 0), ("e", [], 0)]
    assert quantised.encode(spark.createDataFrame(bad, index_df.schema), quantiser).isEmpty()
    assert quantised.top_k(query_df.limit(0), index_df, codes, quantiser, 3).isEmpty()
    with pytest.raises(ValueError):
        quantised.top_k(query_df, index_df, codes, quantiser, 0)
    with pytest.raises(ValueError):
        quantised.learn(index_df, cells=4, parts=5)


def test_same_sample_same_codebooks(clusters):
    index_df = clusters[3]
    one, two = (quantised.learn(index_df.repartition(n), cells=5) for n in (1, 7))
    assert np.isfinite(one.codebooks).all() and one.codebooks.shape == two.codebooks.shape == (8, 256, 2)


def test_query_can_fail(spark, sf, monkeypatch):
    found = retrieval.knn_quantised(spark, sf).first()
    assert found.recall_ok and found.cells_ok and found.n_other_scores == 0
    monkeypatch.setattr(quantised, "choose_copies", lambda *a: 1)
    assert not retrieval.knn_quantised(spark, sf).first().recall_ok


# ---- balls ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, clusters, tmp_path_factory):
    index_df = clusters[3]
    bad = spark.createDataFrame([("a", [float("nan")] * 16, 0), ("b", None, 0), ("d", [1.0], 0)], index_df.schema)
    return balls.build(index_df.unionByName(bad), indexing.train_cells(index_df, 25), str(tmp_path_factory.mktemp("balls") / "balls"))


@pytest.mark.parametrize("k", [1, 10, 300])
def test_balls_are_exact(clusters, stored, k):
    queries, index, query_df, _ = clusters
    found, reads = balls.top_k(query_df, stored, k)
    assert rows(found) == brute(queries, index, k)
    assert reads.count() == len(queries)


def test_balls_leave_cells_out_where_rows_lie_in_clusters(clusters, stored):
    queries, index, query_df, _ = clusters
    _, reads = balls.top_k(query_df, stored, 5)
    share = reads.agg(F.avg("n_cells")).first()[0] / 25
    assert share < 0.7, share


def test_bounds_hold(clusters, stored):
    queries, index, _, _ = clusters
    vectors = np.float64([v for _, v in queries])
    bounds = stored.bounds(vectors)
    for r in stored.index.collect():
        assert (vectors @ np.float64(r.embedding) <= bounds[:, r.cell] + 1e-12).all()


def test_balls_with_filters_unsound_queries_and_no_rows(spark, clusters, stored):
    queries, index, query_df, index_df = clusters
    kept = [r for i, r in enumerate(index) if i % 3 == 2]
    lost = spark.createDataFrame([("x", [float("nan")] * 16), ("y", None), ("z", [1.0])], query_df.schema)
    found, _ = balls.top_k(query_df.unionByName(lost), stored, 7, filters={"kind": 2}, columns=["kind"])
    assert rows(found) == brute(queries, kept, 7)
    assert balls.top_k(query_df.limit(0), stored, 5)[0].isEmpty()
    assert balls.top_k(query_df, stored, 5, filters={"kind": 9})[0].isEmpty()
