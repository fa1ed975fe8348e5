"""Token counts against the tokenizers library's unigram model."""

import random

import pytest
from tokenizers import Tokenizer, models

from sextant.llm import unigram

MARK = unigram.MARK


def library(pieces, byte_pieces):
    vocab = [("<unk>", 0.0), *pieces]
    if byte_pieces:
        vocab += [(f"<0x{i:02X}>", -1e6) for i in range(256)]
    lowest = min(s for _, s in pieces)
    if byte_pieces:  # the byte pieces must not lower the unknown score
        vocab = [(p, lowest if p.startswith("<0x") else s) for p, s in vocab]
    return Tokenizer(models.Unigram(vocab, 0, byte_pieces))


def shaped(text):
    return MARK + text.replace(" ", MARK)


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_random_vocabularies_with_ties(byte_pieces):
    r = random.Random(5)
    for _ in range(60):
        letters = "abc" + MARK
        pieces = {"".join(r.choice(letters) for _ in range(r.randint(1, 4))): -float(r.randint(0, 4)) for _ in range(r.randint(1, 14))}
        pieces.setdefault("<unk>", 0.0)
        pieces.pop("<unk>")
        if not pieces:
            continue
        own, other = unigram.Counter(list(pieces.items()), byte_pieces), library(list(pieces.items()), byte_pieces)
        for _ in range(30):
            text = "".join(r.choice("abcxé  ") for _ in range(r.randint(0, 25)))
            if text:
                assert own.count(text) == len(other.encode(shaped(text)).ids), (pieces, text)


def test_fractional_scores_are_not_split():
    pieces = [("a", -0.1), ("b", -0.7), ("ab", -0.8), (MARK, -0.3), (MARK + "a", -0.4)]
    own, other = unigram.Counter(pieces, False), library(pieces, False)
    for text in ("ab", "a b ab", "ba  ab", "xx ab"):
        assert own.count(text) == len(other.encode(shaped(text)).ids)


def test_public_vocabulary_on_documents(sf_small):
    import pyarrow.parquet as pq

    own = unigram.public_counter()
    other = library(own.pieces, own.byte_pieces)
    texts = pq.read_table(f"{sf_small}/documents.parquet")["text"].to_pylist()[:60] + ["日本語 ０１ 😀", " lead", "trail ", "a\tb\nc", "x" * 5000]
    for text in texts:
        assert own.count(text) == len(other.encode(shaped(text)).ids)


def test_nulls_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (3, "the cat", 9), (3, "the cat", 9)], "doc_id long, text string, n_tokens int")
    rows = unigram.count_tokens(df, unigram.public_counter()).collect()
    own = unigram.public_counter()
    n = len(library(own.pieces, own.byte_pieces).encode(shaped("the cat")).ids)
    assert [r["n_tokens"] for r in rows] == [0, 0, n, n]
    assert unigram.count_tokens(df.limit(0), unigram.public_counter()).collect() == []
