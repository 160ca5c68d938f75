import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.codec(RANKS, PATTERN).ranks
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(0)
    bits = ["the", " ", "  ", "\n", "\t", "é", "ñ1", "12", "'s", "'", "!!", "#$%", "日本", " ", "\U0001f600", "<|endoftext|>", "x" * 30]
    return ["".join(r.choices(bits, k=r.randrange(1, 400))) for _ in range(150)] + ["", "a" * 3000, " " * 3000 + "b", "9" * 500, "\n" * 700]


def test_cut_texts_have_the_same_ids(plain):
    small = bpe.Codec(plain._mergeable_ranks, PATTERN, direct=20, piece=16)
    for t in texts():
        assert small.encode(t) == plain.encode_ordinary(t)
        assert small.decode(small.encode(t)) == t.encode()


def test_heap_merges_as_tiktoken_does(plain):
    codec = bpe.codec(RANKS, PATTERN)
    for t in texts():
        data = t.encode()[:400]
        if data:
            assert codec.merge(data) == plain._encode_single_piece(data)


def test_very_long_runs_end_soon():
    codec = bpe.codec(RANKS, PATTERN)
    for t in ("ab" * 200_000, " " * 300_000 + "x", "é" * 200_000, "!?" * 100_000):
        assert codec.decode(codec.encode(t)) == t.encode()


def test_documents(spark, plain):
    rows = [(i, t, "own") for i, t in enumerate(texts())] + [(900, None, "x"), (1, texts()[1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(frame, RANKS, PATTERN, keep_ids=True).collect()
    by = {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        ids = plain.encode_ordinary(by[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
    for r in bpe.decode(bpe.encode(frame, RANKS, PATTERN), RANKS, PATTERN).collect():
        assert bytes(r.decoded) == by[r.doc_id].encode()
    assert bpe.round_trip(frame.limit(0), RANKS, PATTERN).count() == 0
