"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm import bpe

CODEC = bpe.public_codec()
LIBRARY = tiktoken.Encoding("own", pat_str=CODEC.pattern, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_perfect_hash_finds_every_entry_and_nothing_else():
    keys = list(CODEC.ranks)
    assert CODEC.table.find(keys) == [CODEC.ranks[k] for k in keys]
    assert sorted(CODEC.table.ids.tolist()) == sorted(CODEC.ranks.values())
    others = [k + b"\x00zz" for k in keys[:500]]
    assert CODEC.table.find(others) == [-1] * len(others)


def test_merging_alone_equals_lookup():
    for token in random.Random(1).sample(list(CODEC.ranks), 500):
        assert bpe.merge(token, CODEC.ranks) == LIBRARY.encode_single_token(token) or bpe.merge(token, CODEC.ranks) == [CODEC.ranks[token]]


def test_long_and_odd_texts():
    for text in ("a" * 30_000, " " * 3000 + "x", "\x1c\x1d\x85  a", "<|endoftext|>", "😀🏽" * 50, "don't I'LL"):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_frame(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x")], "doc_id long, text string")
    rows = {(r["doc_id"]): r for r in bpe.digests(df).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0
    assert rows[1]["ids_sha256"] == rows[1]["decoded_sha256"] == empty
    ids = LIBRARY.encode_ordinary("hello world")
    assert rows[3]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert rows[3]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.digests(df.limit(0)).collect() == []
    clash = spark.createDataFrame([("x", "kept", "hi")], "ids string, other string, text string")
    out = bpe.decode(bpe.encode(clash, CODEC), CODEC)
    assert sorted(out.columns) == ["decoded", "ids", "other", "text"]
    assert bytes(out.first()["decoded"]) == b"hi"
