"""Decontamination: planted items, the guarantee of the blocks, odd rows, the plan."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.llm import decontaminate as dc


def prose(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_planted_items(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", limit)
    monkeypatch.setattr(dc, "BROADCAST_TEXTS", limit)
    r = random.Random(7)
    items = [(i, prose(r, r.randint(15, 60))) for i in range(20)]
    docs, want = [], set()
    for i in range(60):
        text = prose(r, r.randint(0, 80))
        if i % 3 == 0:
            item, body = items[i % 20]
            w = body.upper().split()
            if i % 2 and len(w) >= 50:
                w[0] = "edited"
            text = f"{text} \n {'  '.join(w)} {prose(r, 20)}"
            want.add((i, item))
        docs.append((i, text))
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert all(x["similarity"] >= 0.8 and x["hamming"] <= dc.RADIUS for x in got)


def test_blocks_guarantee(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), dc.RADIUS):
            b ^= 1 << bit
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        pairs.append((signed(a), signed(b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    assert df.where(~F.arrays_overlap(dc.blocks(F.col("a")), dc.blocks(F.col("b")))).count() == 0
    assert df.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) != dc.RADIUS).count() == 0


def test_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (1, item), (2, "a b c"), (3, None), (None, item), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, item, 5), (1, item, 5), (None, item, 6), (2, None, 7), (3, "", 8), (4, "a b c", 9), (5, item + " " + item, 10), (1, "other", 11)], "doc_id long, text string, item_id int")
    got = sorted((str(x["doc_id"]), x["item_id"], x["start"]) for x in dc.leaks(docs, items).collect())
    assert got == [("1", 1, 0), ("5", 1, 0), ("5", 1, 20), ("None", 1, 0)]
    kept = sorted((str(x["doc_id"]), x["text"]) for x in dc.clean(docs, items).collect())
    assert kept == [("1", "other"), ("2", None), ("3", ""), ("4", "a b c")]
    assert dc.leaks(docs.limit(0), items).collect() == [] == dc.leaks(docs, items.limit(0)).collect()


def test_plan_is_native(spark):
    docs, items = (spark.createDataFrame([(1, "a b c d e f")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    plan = dc.leaks(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def all_starts(text, item):
    """Similarity of every start, cut off at the text's ends, that reaches 0.8; by brute force."""
    w, v = text.lower().split(), item.lower().split()
    h, b = ([tuple(x[i : i + 5]) for i in range(len(x) - 4)] for x in (w, v))
    found = {}
    for s in range(1 - len(b), len(h)):
        win, want = Counter(h[max(s, 0) : max(s + len(b), 0)]), Counter(b)
        common = (win & want).total()
        if b and common / (win.total() + len(b) - common) >= 0.8:
            found[s] = common / (win.total() + len(b) - common)
    return found


@pytest.mark.parametrize("limit", [200_000, 0])
def test_displaced_parts(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", limit)
    monkeypatch.setattr(dc, "BROADCAST_TEXTS", limit)
    r = random.Random(11)
    items = [(i, prose(r, n)) for i, n in enumerate((59, 59, 120, 30, 6, 200))] + [(6, "a b " * 20)]
    docs = []
    for i in range(80):
        body = items[i % 7][1].split()
        cut = 12 if i < 7 else r.randint(0, len(body) // 3)
        body = body[cut:] + body[:cut]  # the first words at the end
        if i % 5 == 4:
            del body[len(body) // 2]
        docs.append((i, f"{prose(r, r.randint(0, 70))} {' '.join(body)} {prose(r, r.randint(0, 70))}"))
    docs.append((80, f"{items[0][1]} {docs[0][1]}"))  # in place, and with parts swapped
    want = {(i, j): f for i, t in docs for j, b in items if (f := all_starts(t, b))}
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == set(want) and (0, 0) in want
    assert all(abs(want[x["doc_id"], x["item_id"]][x["start"]] - x["similarity"]) < 1e-12 for x in got)
    swapped = [x for x in got if x["doc_id"] == 0]
    assert len(swapped) == 1 and swapped[0]["similarity"] == max(want[0, 0].values()) and swapped[0]["similarity"] == pytest.approx(0.864, abs=5e-4)
    assert len([x for x in got if x["doc_id"] == 80]) == 2


def test_windows_cut_off_at_the_ends(spark):
    """Items of which a text holds only the begin, the end or the middle: every length that still is a leak, by brute force."""
    r = random.Random(21)
    items = [(i, prose(r, n)) for i, n in enumerate((9, 13, 25, 60, 150))]
    docs = []
    for i, body in items:
        w = body.split()
        for gone in range(0, len(w) // 3 + 1):
            for part in (w[gone:], w[: len(w) - gone], w[gone // 2 : len(w) - (gone + 1) // 2]):
                docs.append((len(docs), " ".join(part)))
                docs.append((len(docs), " ".join(part if part is not w else w) + " " + prose(r, 30)))
    want = {(i, j): f for i, t in docs for j, b in items if set(t.split()) & set(b.split()) and (f := all_starts(t, b))}
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == set(want) and len(want) > 40
    assert all(abs(want[x["doc_id"], x["item_id"]][x["start"]] - x["similarity"]) < 1e-12 for x in got)
