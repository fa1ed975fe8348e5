"""Repeated strings against brute force."""

import hashlib
import random
import tempfile

import pytest

from sextant.llm import repeats

L = repeats.LENGTH


def brute(rows):
    """rows: (doc_id, text) with distinct ids; the report and the kept bytes of each."""
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - L + 1):
            window = data[s : s + L]
            if window in first:
                gone[s : s + L] = b"\x01" * L
            else:
                first[window] = 1
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.without_repeats(df.repartition(3)).collect()}
    want = brute(rows)
    assert got == want, [(i, got.get(i), want[i]) for i in want if got.get(i) != want[i]][:3]


def prose(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 997, 61])
def test_suffix_classes_equal_windows(monkeypatch, block):
    monkeypatch.setattr(repeats, "FILE_BLOCK", block)  # blocks of the sequential file
    r = random.Random(2)
    base = prose(r, 80).encode()
    pieces = sorted({base[a : a + r.randint(60, 160)] for a in [r.randint(0, 120) for _ in range(60)]} | {b"a" * 150, b"a" * 130, b"ab" * 70})
    with tempfile.TemporaryDirectory() as folder:
        classes = repeats.suffix_classes(pieces, folder)
    seen = {}
    for piece, own in zip(pieces, classes, strict=True):
        assert len(own) == max(0, len(piece) - L + 1)
        for s, c in enumerate(own.tolist()):
            assert seen.setdefault(piece[s : s + L], c) == c
    assert len(set(seen.values())) == len(seen)


def test_copies_edits_and_overlaps(spark):
    r = random.Random(4)
    passage, rows = prose(r, 40), []
    for i in range(60):
        text = prose(r, r.randint(0, 80))
        kind = i % 6
        if kind == 1:
            text = text + passage + prose(r, 10)
        elif kind == 2 and rows:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 3 and rows:
            base = rows[r.randrange(len(rows))][1]
            cut = r.randint(0, len(base))
            text = base[:cut] + "#" + base[cut:]
        elif kind == 4:
            text = "ab " * r.randint(0, 120) + text + "z" * r.randint(90, 300)
        elif kind == 5:
            text = text + "\n" + text
        rows.append((i * 7 % 61, text))
    check(spark, rows)


def test_hot_anchor_is_cut(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    r = random.Random(8)
    passage = prose(r, 60)
    rows = [(i, prose(r, 6) + " " + passage[r.randint(0, 40) :] + " " + prose(r, 6)) for i in range(40)]
    check(spark, rows)


def test_more_surroundings_than_a_collection_holds(spark, monkeypatch):
    """A passage in very many different surroundings: cut by stretch, then dealt out string by string."""
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "COLLECTION", 1000)
    r = random.Random(9)
    passage = prose(r, 30)[:110]
    check(spark, [(i, prose(r, 9) + passage + prose(r, 9)) for i in range(120)])


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 150)
    r = random.Random(11)
    passage = prose(r, 70)
    check(spark, [(i, prose(r, r.randint(0, 90)) + passage[r.randint(0, 9) :] + "q" * r.randint(0, 400)) for i in range(12)])


def test_nulls_short_repeated_and_clashing(spark):
    text = "x" * 99
    check(spark, [(1, None), (2, ""), (3, text), (4, text + "x"), (5, text + "xx"), (6, "é" * 49 + "e"), (7, "é" * 50), (8, "é" * 51)])
    df = spark.createDataFrame([(1, "a" * 150, 3, "k"), (1, "a" * 150, 4, "k"), (None, "a" * 150, 5, "k")], "doc_id long, text string, n_spans int, other string")
    rows = repeats.without_repeats(df).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"], r["n_spans"]) for r in rows) == [("1", 149, 1), ("1", 149, 1), ("None", 0, 0)]
    assert repeats.without_repeats(df.limit(0)).collect() == []
