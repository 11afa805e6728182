import random

import pytest

from passagebook.llm import linededup as d

STRIP = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def plain(rows, least, chars, keep_first=False):
    docs, first = {}, {}
    order = lambda i: (i is not None, i or 0)  # noqa: E731  Spark sorts nulls first
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for pos, line in enumerate((t or "").split("\n")):
            k = key_of(line)
            if len(k) >= chars:
                docs.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key_of(x)) >= chars and len(docs[key_of(x)]) >= least)]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def case():
    rng = random.Random(1)
    lines = [f"Line {i}" for i in range(25)] + ["", " ", "ÉCOLE", "école", "a\tb", "日本"]
    rows = []
    for i in range(150):
        text = "\n".join(rng.choice([str.upper, str])(rng.choice(["", " ", "\t"]) + x + rng.choice(["", "\r"])) for x in rng.choices(lines, k=rng.randint(0, 9)))
        rows.append((i, text if i % 9 else text + "\n"))
    rows += [(500 + i, "own %d\nhot line" % i) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, "Line 1\nx"), (3, rows[3][1]), (3, "HOT LINE\nmore")]
    # More lines than fit a few words of the bitmap, lost ones far apart.
    return rows + [(950, "\n".join("hot line" if n % 700 == 5 else f"long {n}" for n in range(5000)))]


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
@pytest.mark.parametrize("chars", [1, 5])
def test_equals_plain(spark, broadcast, chars):
    rows = case()
    df = spark.createDataFrame([(*r, "k", 7, "w") for r in rows], "doc_id long, text string, keep string, k1 int, kept_text string").repartition(4)
    maps = d.keep_bitmaps(df, least_docs=10, least_chars=chars, broadcast_keys=broadcast)
    got = d.apply(df, maps)
    assert got.columns == ["doc_id", "text", "keep", "k1", "kept_text", "n_lines", "n_dropped", "kept_text_"]
    assert sorted((str(r.doc_id), r.kept_text_, r.n_lines, r.n_dropped) for r in got.collect()) == plain(rows, 10, chars)
    assert d.apply(df.limit(0), d.keep_bitmaps(df.limit(0))).count() == 0


def test_words_without_lost_lines_are_not_stored(spark):
    df = spark.createDataFrame(case(), "doc_id long, text string")
    longest = max((r.keep for r in d.keep_bitmaps(df).collect()), key=len)
    assert len(longest) == 8 and all(w.bits != -1 for w in longest)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(case(), "doc_id long, text string")
    plan = d.apply(df, d.keep_bitmaps(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
