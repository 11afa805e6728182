import random
from itertools import combinations

from passagebook.llm import decontaminate as d
from passagebook.llm.queries import op10_decontaminate


def plain_words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text or "").split()


def plain(docs, items):
    """All alignments of all texts and items."""
    names = {}
    for i, t in items:
        if i is not None and t is not None:
            key = tuple(plain_words(t))
            names[key] = min(i, names.get(key, i))
    out = []
    for doc, t in docs:
        w = plain_words(t)
        for key, name in names.items():
            if len(key) < d.SHORTEST:
                continue
            need, misses = (d.NEED, d.MISSES) if len(key) >= d.NEED else (len(key), 0)
            best = None
            for o in range(-len(key) + 1, len(w)):
                a, b = max(0, o), min(len(w), o + len(key))
                same = [w[x] == key[x - o] for x in range(a, b)]
                good = [s for s in range(len(same) - need + 1) if sum(same[s : s + need]) >= need - misses]
                if good:
                    s, e = good[0], good[-1] + need
                    now = (-sum(same[s:e]), a + s, e - s)
                    best = now if best is None else min(best, now)
            if best:
                out.append((str(doc), name, best[1], best[2], -best[0]))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.item_id, r.start, r.words, r.matched) for r in df.collect())


def test_no_substitution_escapes_the_masks():
    for gone in combinations(range(d.NEED), d.MISSES):
        assert any(
            all(o + i not in gone for i, c in enumerate(m) if c == "1")
            for m in d.MASKS for o in range(d.NEED - len(m) + 1)
        ), gone


def case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["é", "日本"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 4, 5, 8, 12, 13, 14, 30, 60])))) for i in range(30)]
    items += [(40, items[7][1].upper() + "!"), (None, "a b c d e f"), (41, None), (42, ""), (43, "x " * 20)]
    docs = []
    for i in range(200):
        body = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items[:30])[1].split()
            cut = rng.randint(0, len(part) // 2)
            part = part[cut : cut + rng.choice([8, 13, 14, 40])]
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                part[rng.randrange(len(part))] = "other" if part else ""
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(900, None), (901, ""), (902, " ?! "), (None, items[20][1]), (3, docs[3][1]), (903, "x " * 3000)]
    return docs, items


def test_equals_all_alignments(spark):
    docs, items = case(1)
    frame = spark.createDataFrame([(*r, "h", 1) for r in docs], "doc_id long, text string, hits string, item_id int")
    bench = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, doc_id int")
    want = plain(docs, items)
    assert len(want) > 40
    assert rows_of(d.leaks(frame, bench)) == want
    assert rows_of(d.leaks(frame, bench, block_words=200)) == want
    scanned = d.scan(frame, bench)
    assert scanned.columns == ["doc_id", "text", "hits", "item_id", "hits_"] and scanned.count() == len(docs)
    assert d.leaks(frame.limit(0), bench).count() == 0
    assert d.leaks(frame, bench.limit(0)).count() == 0


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(op10_decontaminate(spark, sf))
    leaked = {(str(i), n) for i, t in docs for n, x in items if " ".join(plain_words(x)) in " ".join(plain_words(t))}
    assert leaked <= {r[:2] for r in got}
    short = [(i, t) for i, t in docs if len(t) < 1500]
    assert [r for r in got if r[0] in {str(i) for i, _ in short}] == plain(short, items)
