import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from passagebook.llm import bpe, simhash
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_simhash import plain_components, plain_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, size=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with copies, near copies at a known similarity, and texts that share a part."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(4000)]
    rows, near = [], []
    for i in range(120):
        rows.append((i, " ".join(rng.choices(words, k=rng.choice([30, 80, 300, 1200]))), "en", "s", 1))
    for i in range(100):
        base = rows[i][1].split()
        changed = list(base)
        for _ in range(max(1, len(base) // 100)):
            changed[rng.randrange(len(base))] = "other"
        if jaccard(rows[i][1], " ".join(changed)) >= 0.8:
            near.append((i, 200 + i))
        rows.append((200 + i, " ".join(changed), "en", "s", 1))
    half = [(400 + i, " ".join(rows[i][1].split()[: len(rows[i][1].split()) // 2] + rng.choices(words, k=200)), "en", "s", 1) for i in range(60)]
    copies = [(500 + i, rows[7][1], "en", "s", 1) for i in range(40)]
    odd = [(600, None, None, None, None), (601, "", "en", "s", 0), (None, "one two", "en", "s", 7), (None, "one two", "en", "s", 7), (3, rows[3][1], "en", "s", 1)]
    return rows, near, half, copies, odd


def test_near_dedup(spark, corpus):
    rows, near, half, copies, odd = corpus
    docs = spark.createDataFrame(rows + half + copies + odd, KINDS)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == COLUMNS
    got = kept.collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and None in ids
    assert {i for i in range(120)} <= set(ids)  # the first of each group stays
    assert {i for i, *_ in half} <= set(ids)  # texts that share a half are left alone
    assert not {i for i, *_ in copies} & set(ids) and 600 in ids and 601 not in ids
    assert len(near) > 40 and sum(b in ids for _, b in near) <= 0.02 * len(near)
    few = simhash.drop_near_duplicates(docs, broadcast_ids=0).collect()
    assert sorted(map(str, few)) == sorted(map(str, got))
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_similarity_is_exact(corpus):
    rows = corpus[0]
    for a, b in ((0, 1), (3, 123), (5, 125), (8, 128), (9, 129)):
        x, y = rows[a][1], rows[b][1]
        got = simhash.similarity(*[simhash._numbers(simhash.profile(t.encode(), 5)[1]) for t in (x, y)])
        assert got == pytest.approx(jaccard(x, y), abs=1e-9)


def test_tallies_never_part_similar_sets_and_part_most_others():
    rng = np.random.default_rng(1)
    parted = 0
    for n in (1, 2, 9, 60, 127, 128, 129, 500, 2100, 9000):
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**64, 2 * n + 3, dtype=np.uint64))
            rng.shuffle(pool)
            for share in (0.0, 0.3, 0.6, 0.8, 0.9, 1.0):
                common = int(round(share * 2 * n / (1 + share)))
                x, y = np.sort(pool[:n]), np.sort(np.r_[pool[:common], pool[n : 2 * n - common]])
                real = simhash.similarity(x, y)
                may = simhash.may_reach(0.8, simhash.tally(x), simhash.tally(y), len(x), len(y))
                assert may or real < 0.8
                parted += share <= 0.3 and n >= 60 and not may
    assert parted >= 0.9 * 2 * 20 * 7
    crowded = np.arange(2000, dtype=np.uint64)  # all in one range: no tally, so never parted
    assert simhash.tally(crowded) == b"" and simhash.may_reach(0.8, b"", simhash.tally(pool), 2000, 9)


def roots_of(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], KINDS)
    return {r.doc_id: r.root for r in simhash.similar_groups(docs, **how).collect()}


def edited(base, rng, places, tag):
    """base with words changed at so many places, far enough apart to lose five shingles each."""
    out = list(base)
    for k in rng.sample(range(len(base) // 10), places):
        out[10 * k + 5] = f"{tag}x{k}"
    return " ".join(out)


def plain_roots(texts, least=0.8):
    root = list(range(len(texts)))
    sets = [grams(t) for t in texts]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= least:
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def same_partition(got, want):
    first = {}
    return all(first.setdefault(("g", got[i]), w) == w and first.setdefault(("w", w), got[i]) == got[i] for i, w in enumerate(want))


def test_similarity_counts_whole_sets(spark):
    """Long texts just above and just below the limit, each pair on its own."""
    rng = random.Random(8)
    texts, joined = [], []
    for k in range(60):
        base = [f"t{k}w{i}" for i in range(1804)]  # 1800 shingles; 5 n of them go with n places
        for places, similar in ((39, True), (41, False)):
            base = [w + "ab"[similar] for w in base]
            texts += [" ".join(base), edited(base, rng, places, f"t{k}e")]
            assert (jaccard(*texts[-2:]) >= 0.8) == similar
            joined.append(similar)
    got = roots_of(spark, texts)
    assert [got[2 * i] == got[2 * i + 1] for i in range(len(joined))] == joined


def test_every_pair_at_the_limit_is_found(spark):
    """Pairs from 0.80 to 0.85, short and long, also behind a passage that all documents share."""
    rng = random.Random(9)
    passage, texts = [f"p{i}" for i in range(120)], []
    for k in range(240):
        size = rng.choice([45, 60, 150, 400])
        base = [f"k{k}w{i}" for i in range(size)]
        shared = passage if k % 2 else []
        for places in range(size // 10, 0, -1):
            other = edited(base, rng, places, f"k{k}e").split()
            if jaccard(" ".join(shared + base), " ".join(shared + other)) >= 0.8:
                break
        texts += [" ".join(shared + base), " ".join(shared + other)]
    near = [jaccard(texts[2 * i], texts[2 * i + 1]) for i in range(240)]
    assert sum(0.8 <= s <= 0.85 for s in near) > 100
    for sample in (simhash.SAMPLE, 3000):
        assert same_partition(roots_of(spark, texts, sample=sample), plain_roots(texts))


def test_every_pair_of_a_large_class_is_compared(spark):
    """Copies of one text that are similar to it only, and a chain of versions."""
    rng = random.Random(10)
    base = [f"b{i}" for i in range(404)]
    copies = [edited(base, rng, 8, f"c{i}") for i in range(150)]
    assert all(jaccard(" ".join(base), c) >= 0.8 for c in copies) and jaccard(copies[0], copies[1]) < 0.75
    chain, now = [], [f"v{i}" for i in range(204)]
    for i in range(120):
        chain.append(" ".join(now))
        at = (i * 20) % 200
        now = [*now[:at], *[f"n{i}w{j}" for j in range(15)], *now[at + 15 :]]
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(chain, chain[1:])) and jaccard(chain[0], chain[5]) < 0.6
    texts = copies[:70] + [" ".join(base)] + copies[70:] + chain + ["", None, " \n"]
    got = roots_of(spark, texts)
    assert len({got[i] for i in range(151)}) == 1
    assert same_partition(got, plain_roots(texts))


def test_shingles_of_many_unlike_texts_make_few_pairs(spark, monkeypatch):
    """A passage that the sample does not show: it brings all texts together once, then none."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(passage + [f"u{k}w{i}" for i in range(70)]) for k in range(150)]
    texts += [" ".join(edited(texts[k].split(), rng, 2, f"e{k}").split()) for k in range(0, 150, 3)]
    made, meetings = [], simhash._possible

    def counted(pairs, *args):
        made.append(pairs.count())
        return meetings(pairs, *args)

    monkeypatch.setattr(simhash, "_possible", counted)
    monkeypatch.setattr(simhash, "DENSE", 10**9)  # crowds have a test of their own
    monkeypatch.setattr(simhash, "frequencies", lambda *a: (np.empty(0, np.uint64), np.empty(0, np.int32)))
    got = {}
    for hot in (10**9, 20):
        monkeypatch.setattr(simhash, "HOT", hot)
        made.clear()
        assert same_partition(roots_of(spark, texts), plain_roots(texts))
        got[hot] = made[1]
    assert got[20] < 100 < 5000 < got[10**9]


@pytest.mark.parametrize("dense,turns", [(0, 3), (10**9, 3), (0, 0)])
def test_crowds_of_near_copies(spark, monkeypatch, dense, turns):
    """Edited copies of a short text, some similar to each other by 0.8 and some not, in each of
    the ways in which they may be compared."""
    rng = random.Random(12)
    texts = []
    for k in range(3):
        base = [f"b{k}w{i}" for i in range(104 + 60 * k)]
        texts += [edited(base, rng, rng.choice([1, 2, 3]), f"c{k}x{i}") for i in range(70)]
    want = plain_roots(texts)
    assert 20 < len(set(want)) < 150
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "TURNS", turns)
    monkeypatch.setattr(simhash, "HOT", 30)
    assert same_partition(roots_of(spark, texts), want)


def test_line_dedup_keeps_the_first(spark):
    rows = [(i, f"Common line \nown {i}\n\nCOMMON LINE\n", "en", "s", 30) for i in range(12)] + [(50, "rare\nrare", "en", "s", 9), (51, None, "en", "s", None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in p.line_dedup(spark, spark.createDataFrame(rows, KINDS), "").collect()}
    assert got[0] == ("Common line \nown 0\n\n", 20)
    assert all(got[i] == (f"own {i}\n\n", len(f"own {i}\n\n")) for i in range(1, 12))
    assert got[50] == ("rare\nrare", 9) and got[51] == (None, None)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "123 ?!", "en", "s", 6), (10**6 + 1, None, None, None, None)], KINDS)
    docs = docs.unionByName(extra.select(*docs.columns)).withColumn("lang_pred", F.lit("clash")).withColumn("hits", F.lit(1))
    first = p.language_id(spark, docs, sf)
    assert first.columns == COLUMNS
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    short = docs.filter("n_chars < 1500")
    leaked = {r[0] for r in plain_leaks([(r.doc_id, r.text) for r in short.collect()], items)}
    stayed = {r.doc_id for r in p.decontamination(spark, short, sf).collect()}
    assert {r.doc_id for r in short.collect()} - {int(i) for i in leaked} == stayed
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    got = p.run(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert 0 < len(got) < len(texts)
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    token = {i: t for t, i in ranks.items()}
    for r in got:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        decoded = b"".join(token[i] for i in ids)
        assert len(ids) == r.n_tokens and hashlib.sha256(decoded).hexdigest() == r.decoded_sha256
        lines = iter(texts[r.doc_id].split("\n"))
        assert all(any(x == y for y in lines) for x in decoded.decode().split("\n") if x)


def test_language_stage_without_languages(spark):
    rows = [(1, "some text", None, "s", 9), (2, "жж 1", None, "s", 4), (3, "12 !?", None, "s", 5), (4, "", None, "s", 0), (5, None, None, "s", None)]
    got = p.language_id(spark, spark.createDataFrame(rows, KINDS), "")
    assert got.columns == COLUMNS and {r.doc_id for r in got.collect()} == {1, 2}


def test_near_dedup_is_by_fingerprints(spark, corpus):
    """The first of each group that fingerprints of five words link at three bits, and no other."""
    rows, _, half, copies, odd = corpus
    rows = rows + half + copies + odd
    prints = [plain_fingerprint(r[1], 5) for r in rows]
    roots = plain_components(prints, 3)
    firsts = {}
    for r, fp in zip(rows, prints):
        firsts[roots[fp]] = min(firsts.get(roots[fp], (True, 0)), (r[0] is None, r[0] or 0))
    kept = p.near_dedup(spark, spark.createDataFrame(rows, KINDS), "")
    assert kept.columns == COLUMNS
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted(firsts.values()) and (True, 0) in got
