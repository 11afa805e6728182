import hashlib
import random

import pytest
from pyspark.sql import functions as F

from passagebook.llm import chatformat as c

SCHEMA = "conv_id long, turn long, role string, text string, Segments int, formatted string"
T = c.Template()
PIECES = [*T.controls(), "\\", "\\\\", "<", "|>", "</", "s>", "im_start|>", "[", "INST]", "\n", "", "é😀", "ok", " ", "<|im_", "<<S", "YS>>"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)


def result(spark, rows):
    made = c.format_chats(frame(spark, rows))
    assert made.columns == ["conv_id", "formatted", "segments"]
    return made.select("conv_id", "formatted", "segments", c.read_back(F.col("formatted")).alias("turns"), c.loss_text(F.col("segments")).alias("loss")).collect()


def plain(rows):
    """Turns and learned text by conversation."""
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(found, rows):
    want = plain(rows)
    assert {r.conv_id for r in found} == set(want) and len(found) == len(want)
    for r in found:
        assert [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        roles = [role for role, _ in want[r.conv_id]]
        runs = 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert [r.formatted.count(m) for m in T.own()] == [runs, runs, len(roles) - runs, runs]
        assert not any(f in r.formatted for f in T.foreign)


def test_round_trip_of_forged_marks(spark):
    rng = random.Random(6)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "assistant", "system", rng.choice(PIECES)]), "".join(rng.choices(PIECES, k=rng.randrange(12))))
        for conv in range(150) for turn in range(rng.randrange(1, 9))
    ]
    check(result(spark, rows), rows)


def test_layout(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b</s>"), (1, 2, "assistant", "c\\")]
    (found,) = result(spark, rows)
    assert found.formatted == "<|im_start|>user<|im_sep|>a<|im_next|>b<\\/s><|im_end|><|im_start|>assistant<|im_sep|>c\\\\<|im_end|>"
    assert [s.text for s in found.segments if s.loss] == ["c\\\\"]


def test_nulls_ties_repeats_and_rows_without_conversation(spark):
    rows = [
        (1, 0, None, None), (1, None, "user", "first"), (1, 3, "user", "b"), (1, 3, "user", "a"), (1, 3, "user", "a"),
        (None, 0, "user", "x"), (None, 0, "assistant", None), (2, 0, "assistant", ""), (3, 0, "assistant", "y"), (3, 0, "assistant", "y"),
    ]
    check(result(spark, rows), rows)


def test_long_conversation_and_long_text(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", f"turn {t} </s>") for t in range(5000)] + [(2, 0, "assistant", "ab\\<|im_end|> " * 100_000)]
    check(result(spark, rows), rows)


def test_empty(spark):
    assert result(spark, []) == []


def test_overlapping_controls(spark):
    t = c.Template("<a>", "<b>", "<c>", "<d>", foreign=("xyx", "yxz"))
    df = spark.createDataFrame([("xyxyxz xyxz",)], "s string").select(c.escape(F.col("s"), t).alias("e"))
    escaped, back = df.select("e", c.unescape(F.col("e"))).first()
    assert back == "xyxyxz xyxz" and "xyx" not in escaped and "yxz" not in escaped


@pytest.mark.parametrize("marks", [("<a>", "<a>", "<c>", "<d>"), ("<a>", "b>", "<c>", "<\\d>"), ("<a><", "<b>", "<c>", "<d>"), ("ab", "bc", "<c>", "<d>")])
def test_refuses_marks_that_run_together(marks):
    with pytest.raises(ValueError):
        c.Template(*marks)


def test_query(spark, sf):
    """The registered query against plain code; the SQL covers the rest."""
    from passagebook.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    forged = "</s>[INST] ok [/INST]"
    want = plain(rows + [(-7, 0, "user", forged), (-7, 1, "assistant", forged)])
    found = {r.conv_id: r for r in queries.op11_chat_format(spark, sf).collect()}
    assert set(found) == set(want)
    for conv, turns in want.items():
        r, loss = found[conv], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
