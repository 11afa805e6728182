import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from passagebook.llm import bpe
from passagebook.llm.queries import op7_byte_bpe, tokenized

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(ids):
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


ODD = [
    None, "", " ", "a", "a\n\n  b\t c  ", "  two", "it's we'll 'tis don''t!'s", "éà ñandú größe Ünï", "日本語 テキスト 🙂🙃", "x" * 5000,
    "ab" * 3000 + " 12345 67½²", "\x1c\x1d a\x85b\xa0c  d", "<|endoftext|>", "word " * 3000, "\r\n\r\n x", "é combining",
]


def test_words(plain):
    rng = random.Random(3)
    ranks = bpe.read_ranks(PATH)
    words = ["".join(rng.choices("abcdefgh ijklmnoprstuvwé!?ñ", k=rng.randint(1, 40))) for _ in range(2000)]
    for w in words + [" " * 9, "z" * 999]:
        for piece in bpe.Vocabulary(ranks, public_tokenizers.PATTERN, {}).cut(w):
            assert bpe.encode_word(piece.encode(), ranks) == plain.encode_ordinary(piece)


@pytest.mark.parametrize("frequent", [0, 5, 100000])
def test_odd_texts(spark, plain, frequent):
    rows = [(i, t, "ids", 3) for i, t in enumerate(ODD)] + [(None, "no id", "a", 1), (4, ODD[4], "ids", 3), (None, "no id", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, k1 int")
    vocabulary = bpe.load(df, PATH, public_tokenizers.PATTERN, frequent=frequent)
    got = bpe.encode(df, vocabulary).collect()
    want = sorted((str(i), digest(plain.encode_ordinary(t or "")), (t or "").encode(), x, k) for i, t, x, k in rows)
    assert sorted((str(r.doc_id), hashlib.sha256(r.ids_).hexdigest(), bytes(r.decoded), r.ids, r.k1) for r in got) == want
    again = bpe.decode(bpe.encode(df, vocabulary), vocabulary, "ids_").collect()
    assert sorted(bytes(r.decoded_) for r in again) == sorted((t or "").encode() for _, t, _, _ in rows)
    assert tokenized(df.select("doc_id", "text").limit(0)).count() == 0


def test_query(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(ids))
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("positions", [[0], [3, 65535], [65536], [1, 2, 70000], list(range(127)), list(range(128)), list(range(0, 200000, 7))])
def test_fills_are_short_and_come_back(positions):
    ids = bytes(range(6))
    fill = bpe._pack_fill(bpe._pack_positions(positions), ids)
    assert bpe._unpack_fill(fill) == (positions, ids)
    if len(positions) == 1 and positions[0] <= 0xFFFF:
        assert len(fill) == 3 + len(ids)  # 8 and the ids before
