"""The n-gram join against brute force."""

import random
import re

import pytest

from sextant.llm import _sets, ngram_join


def shingle_set(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 90 * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df).collect()}
    assert got == brute(rows)


def corpus(r, n):
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(30))
    rows = []
    for i in range(n):
        kind = r.randrange(5)
        if kind == 0 or not rows:
            text = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        elif kind == 1:
            text = passage + " " + " ".join(r.choice(words) for _ in range(r.randint(10, 60)))
        elif kind == 2:
            text = rows[r.randrange(len(rows))][1]
        else:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(1, 2)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words).upper()
            text = "\n ".join(w)
        rows.append((i * 13 % 997 - 50, text))
    return rows


def test_random_corpus(spark):
    check(spark, corpus(random.Random(1), 220))


def test_chain_of_near_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(_sets, "BLOCK", 4)  # hot tokens are compared block by block
    r = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(40):
        base = list(base)
        base[r.randrange(len(base))] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    check(spark, rows)


def test_threshold_is_exact(spark):
    a = [f"a{i}" for i in range(21)]
    rows = [(1, " ".join(a)), (2, " ".join([*a, "b0"])), (3, " ".join([*a, "b0", "b1", "b2"]))]
    check(spark, rows)  # 19/20, 19/22, 20/22


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}x{i % 89}" for i in range(20_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (2, "one"), (1, "ONE"), (9, "one two"), (8, "One  two"), (7, "two one"), (20, long), (19, long + " more")]
    check(spark, rows)
    df = spark.createDataFrame([(1, "a b c d", 1, "x"), (1, "a b c d", 2, "y"), (None, "a b c d", 3, "z"), (2, "a b c d", 4, "z")], "doc_id long, text string, component_id int, k1 string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.linked(df).collect())
    assert got == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 2, None)]
    assert ngram_join.linked(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 5, 10, 100, 5261])
def test_prefix_and_overlap_bounds(n):
    rule = ngram_join.RULE
    need = -(-9 * n // 10)
    assert int(rule.prefix(n)) == n - need + 1
    assert rule.overlap(2 * n) == -(-18 * n // 19)


def test_number_of_links(spark, monkeypatch):
    monkeypatch.setattr(_sets, "BLOCK", 4)
    base = [f"t{i}" for i in range(120)]
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 120, 8)]  # all pairs link
    rows = list(enumerate([*near, *near[:3], *corpus_texts(random.Random(4), 60)]))
    sets = {i: shingle_set(t) for i, t in rows}
    want = {i: sum(bool(s) and j != i and 10 * len(s & t) >= 9 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    assert want[0] == 17
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.linked(df).collect()} == want


def corpus_texts(r, n):
    return [t for _, t in corpus(r, n)]
