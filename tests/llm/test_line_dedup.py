"""Line dedup against brute force."""

import random
import re

import pytest

from sextant.llm import _sets, line_dedup


def word_set(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def brute(rows):
    seen, out = [], {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            s = word_set(line)
            if not s or not any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = None if text is None else "\n".join(kept)
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in line_dedup.without_lines(df).collect()}


@pytest.mark.parametrize("block, most", [(2048, 3_000_000), (3, 40)])
def test_random_lines(spark, monkeypatch, block, most):
    monkeypatch.setattr(_sets, "BLOCK", block)  # groups are cut
    monkeypatch.setattr(_sets, "SHARD_MOST", most)
    monkeypatch.setattr(_sets, "SHARD", most)
    monkeypatch.setattr(_sets, "NEAR", block)
    monkeypatch.setattr(_sets, "SMALL_LISTS", most)
    monkeypatch.setattr(_sets, "TOK_BITS", 43 if block > 3 else 4)
    monkeypatch.setattr(_sets, "OFTEN", 20 if block == 3 else 72)  # words stand in twos
    r = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    pool, rows = [], []
    for i in range(90):
        lines = []
        for _ in range(r.randint(0, 6)):
            kind = r.randrange(4)
            if kind == 0 and pool:
                line = r.choice(pool).upper() + "  "
            elif kind == 1 and pool:
                w = r.choice(pool).split()
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
                line = " ".join(w)
            else:
                line = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 6, 30, 60])))
            pool.append(line)
            lines.append(line)
        rows.append((i * 7 % 97, "\n".join(lines)))
    got = run(spark, rows)
    assert {i: r["kept"] for i, r in got.items()} == brute(rows)
    for i, text in rows:
        assert got[i]["n_lines"] == text.count("\n") + 1
        assert got[i]["n_removed"] == text.count("\n") + 1 - (got[i]["kept"].count("\n") + 1 if got[i]["kept"] or got[i]["n_removed"] < got[i]["n_lines"] else 0)


def test_odd_rows(spark):
    got = run(spark, [(1, "a\n\nA\n"), (2, None), (3, ""), (4, "a"), (5, "b\r\nb")])
    assert {i: r["kept"] for i, r in got.items()} == {1: "a\n\n", 2: None, 3: "", 4: "", 5: "b\r"}
    df = spark.createDataFrame([(1, "x y", 9), (1, "x y", 8), (1, "z\nx y", 7), (None, "x y", 6)], "doc_id long, text string, kept int")
    rows = sorted((str(r["doc_id"]), r["kept"]) for r in line_dedup.without_lines(df).collect())
    assert rows == [("1", "x y"), ("1", "x y"), ("1", "z"), ("None", "x y")]
    assert line_dedup.without_lines(df.limit(0)).collect() == []


def test_a_changed_word_and_very_long_lines(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    base = [[word() for _ in range(n)] for n in (10, 12, 30, 63, 64, 66, 300, 6000)]
    lines = [" ".join(b) for b in base]
    for b in base:
        for share in (0.04, 0.09, 0.15):
            w = list(b)
            for i in r.sample(range(len(w)), max(1, int(len(w) * share))):
                w[i] = word()
            lines.append(" ".join(w))
    r.shuffle(lines)
    rows = [(i, "\n".join(lines[i::5])) for i in range(5)]
    assert {i: x["kept"] for i, x in run(spark, rows).items()} == brute(rows)
