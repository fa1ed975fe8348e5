"""The audit against every order applied one document at a time."""

import itertools
import random
import re

from sextant.llm import filter_audit

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" if len(words) < 200 else ""
        fails += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        fails += "D" if re.search("[#$%&*|]", text) else ""
        fails += "E" if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else ""
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            gone = []
            for step, letter in enumerate(order, 1):
                here = [r for r in left if letter in r[1]]
                redundant = sum(letter in r[1] for r in gone)
                left = [r for r in left if letter not in r[1]]
                gone += here
                removed_by[letter] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, sum(r[1] == letter for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels, more=()):
    frame = spark.createDataFrame(docs, DOCS)
    got = filter_audit.audit(frame.selectExpr("*", *more).repartition(3), spark.createDataFrame(labels, LABELS))
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got.collect()}


def test_as_brute_force(spark):
    chance = random.Random(5)
    words = ["alpha", "beta", "Gamma", "DELTA", "x|y", "é", "\x0b", "\x0c", " ", "\x1f", " "]
    texts = ["", None, " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(199)), "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "w " * 400, "w q " * 1 + "w " * 2, "#" * 3]
    texts += [" ".join(chance.choice(words) + (str(chance.randrange(300)) if chance.random() < 0.6 else "") for _ in range(chance.choice([3, 150, 260]))) for _ in range(12)]
    docs = [(k if chance.random() < 0.9 else None, chance.choice(texts), chance.choice(["en", "de", "", None])) for k in range(120)]
    docs += docs[:9] + [(3, "same", "en"), (3, "same", "de"), (3, "other", "en"), (9, "same", "de")]  # rows that repeat an id
    labels = [(chance.randrange(120), chance.choice([0, 1, None]), chance.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_one_text_in_most_rows(spark):
    docs = [(k, "same text", "en") for k in range(3000)] + [(5000 + k, f"own {k}", "fr") for k in range(50)]
    got = run(spark, docs, [(0, 1, 0), (7, 1, 1)])
    assert got["en", "EABCD", 1] == (1, 2999, 0, 0, 1, 1, sum(got["en", o, s][1] for (p, o, s) in got if p == "en" and o[s - 1] == "E"))
    assert got == brute(docs, [(0, 1, 0), (7, 1, 1)])


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "a", "en"), (2, "a", None)]
    assert run(spark, docs, [], ["'z' AS address", "7 AS mask", "8 AS n", "true AS part", "1 AS quality", "'q' AS label_id"]) == brute(docs, [])


def test_a_very_long_text(spark):
    docs = [(1, "lorem ipsum " * 600_000, "en"), (2, "x" * 5_000_000, "en")]
    got = run(spark, docs, [])
    assert got["en", "ABCDE", 1][1] == 1 and got["en", "BACDE", 1][1] == 1
