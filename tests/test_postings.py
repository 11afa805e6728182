import numpy as np
import pytest

from passagebook.operators import balls, indexing, postings

WORDS = [f"w{i}" for i in range(60)]


def brute(queries, index, k, keyword=0.3, semantic=0.7):
    out = []
    for qid, text, q in queries:
        asked = set((text or "").lower().split())
        scored = []
        for c, content, v, _ in index:
            share = len(asked & set((content or "").lower().split())) / max(len(asked), 1)
            near = round(float(np.dot(np.float64(q), np.float64(v))), 6) + 0.0
            scored.append((round(semantic * near + keyword * share, 10), c))
        scored.sort(key=lambda s: (-s[0], s[1]))
        out += [(qid, i + 1, s, c) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Chunks whose words have nothing to do with their vectors; "the" is in nearly all."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 12))

    def units(n):
        v = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, 12)) * 0.3
        return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32).tolist()

    def text(n):
        words = list(rng.choice(WORDS, n, p=np.arange(1, 61) / np.arange(1, 61).sum()))
        return " ".join(["The"] * (rng.random() < 0.95) + words)

    index = [(f"c{i * 7919 % 1000:04d}", text(rng.integers(1, 9)), v, i % 2) for i, v in enumerate(units(600))]
    index += [("e1", "", index[0][2], 0), ("e2", None, index[1][2], 1), ("e3", "w0 " * 50, index[2][2], 0)]
    queries = [(f"q{i}", text(rng.integers(1, 7)), v) for i, v in enumerate(units(25))]
    queries += [("blank", " ", queries[0][2]), ("none", None, queries[1][2]), ("unknown", "zzz yyy", queries[2][2]), ("zero", "w0 w1", [0.0] * 12)]
    index_df = spark.createDataFrame(index, "chunk_id string, content string, embedding array<float>, kind int").repartition(5)
    folder = tmp_path_factory.mktemp("postings")
    made = balls.build(index_df, indexing.train_cells(index_df, 20), str(folder / "balls"))
    stored = postings.build(made, str(folder / "postings"), block_rows=10)
    return queries, index, spark.createDataFrame(queries, "query_id string, query_text string, query_vector array<float>"), stored


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "score", "chunk_id").collect())


@pytest.mark.parametrize("k,keyword,semantic", [(1, 0.3, 0.7), (10, 0.3, 0.7), (5, 0.9, 0.1), (5, 0.0, 1.0), (400, 0.3, 0.7)])
def test_equals_brute(data, k, keyword, semantic):
    queries, index, query_df, stored = data
    found, _ = postings.top_k(query_df, stored, k, keyword, semantic)
    assert rows(found) == brute(queries, index, k, keyword, semantic)


def test_finds_what_is_not_near(data):
    """Chunks beyond the 2k nearest are among the best."""
    queries, index, query_df, stored = data
    from passagebook.operators import ranking, search

    near = search.top_k(query_df, stored.balls.index, 10, columns=["content"])
    few = {(r.query_id, r.chunk_id) for r in ranking.hybrid(near, query_df.fillna(""), 5).collect()}
    best = {(r.query_id, r.chunk_id) for r in postings.top_k(query_df, stored, 5)[0].collect()}
    assert best - few


def test_blocks_are_bounded_and_skipped(data):
    queries, index, query_df, stored = data
    assert stored.blocks.agg({"n": "max"}).first()[0] < 40
    _, counts = postings.top_k(query_df, stored, 5)
    total = counts.agg({"n_blocks": "sum", "n_read": "sum"}).first().asDict()
    assert 0 < total["sum(n_read)"] < 0.3 * total["sum(n_blocks)"], total


def test_no_rows_and_wrong_weights(data):
    _, _, query_df, stored = data
    assert postings.top_k(query_df.limit(0), stored, 3)[0].isEmpty()
    for options in ({"k": 0}, {"semantic_weight": 0.0}, {"keyword_weight": -1.0}):
        with pytest.raises(ValueError):
            postings.top_k(query_df, stored, **options)


def test_only_pairs_that_can_count_carry_their_text():
    one = np.array([[1.0, 0.0]])
    vectors, asked = np.repeat(one, 4, axis=0), np.array([[0.9, 0.1], [0.2, 0.9], [0.2, 0.9], [0.5, 0.0]])
    n_hit, floor, n_terms, n_unread = np.array([1, 1, 9, 2]), np.full(4, 0.4), np.full(4, 10), np.array([0, 1, 0, 0])
    near, can = postings._scored((0.7, 0.3), vectors, asked, n_hit, floor, n_terms, n_unread)
    # 0.66; 0.14 + 0.06 is too little; 0.14 + 0.27 is enough; 0.35 + 0.06 is.
    assert near.tolist() == [0.9, 0.2, 0.2, 0.5] and can.tolist() == [0, 2, 3]


def test_queries_too_many_to_broadcast_find_the_same(spark, sf, monkeypatch):
    from passagebook.plans import retrieval

    few = sorted(map(tuple, retrieval.hybrid_exact(spark, sf).collect()))
    monkeypatch.setattr(postings, "_small", lambda queries: None)
    assert sorted(map(tuple, retrieval.hybrid_exact(spark, sf).collect())) == few
