"""The language model against a direct computation of its formula."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sextant.llm import kneser_ney as kn


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


class Direct:
    def __init__(self, texts):
        self.words, self.pairs, self.context = Counter(), Counter(), Counter()
        for t in texts:
            own = tokens(t)
            self.words.update(own)
            for a, b in zip(["<s>", *own], own):
                self.pairs[a, b] += 1
                self.context[a] += 1
        self.before, self.after = Counter(), defaultdict(Counter)
        for (a, b), c in self.pairs.items():
            self.before[b] += 1
            self.after[a][min(c, 3)] += 1
        of = lambda c: kn.discounts(np.array([0] + [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)] + [0]))
        self.d2, self.d1 = of(self.pairs), of(self.before)

    def lower(self, w):
        total, t = len(self.pairs), self.before[w]
        freed = sum(self.d1[min(c, 3)] for c in self.before.values())
        return max(t - self.d1[min(t, 3)], 0) / total + freed / total / (len(self.words) + 1)

    def p(self, w, v):
        if not self.context[v]:
            return self.lower(w)
        c = self.pairs[v, w]
        g = sum(self.d2[k] * n for k, n in self.after[v].items()) / self.context[v]
        return max(c - self.d2[min(c, 3)], 0) / self.context[v] + g * self.lower(w)

    def score(self, text):
        own = tokens(text)
        return sum(math.log10(self.p(b, a)) for a, b in zip(["<s>", *own], own))

    def base(self, text):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[w] + 1) / (n + v + 1)) for w in tokens(text))


@pytest.mark.parametrize("shard", [2_000_000, 40])
def test_equals_the_formula(spark, monkeypatch, shard):
    monkeypatch.setattr(kn, "SHARD_TOKENS", shard)
    r = random.Random(9)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(500)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "never seen W1 w1"), (503, "é\tÀ w2")]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    direct = Direct(train)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = kn.learn(df.where(kn.fold(df["doc_id"]) != kn.HELD_OUT))
    assert model.distinct == len(direct.words) and model.tokens == sum(direct.words.values()) and model.pairs == len(direct.pairs)
    vocabulary = [*direct.words, "unknown"]
    for v in ("<s>", vocabulary[0], "unknown"):
        assert abs(sum(direct.p(w, v) for w in vocabulary) - 1) < 1e-9  # the direct form is a distribution
    got = {x["doc_id"]: x for x in kn.score(df, model).collect()}
    for i, text in rows:
        x = got[i]
        assert abs(x["score"] - direct.score(text)) < 1e-8 and abs(x["base_score"] - direct.base(text)) < 1e-8
        assert x["n_tokens"] == len(tokens(text)) and x["n_known"] == sum(w in direct.words for w in tokens(text)) and x["train_tokens"] == model.tokens


def test_model_beats_its_base_on_held_out_text(spark, sf_small):
    rows = kn.op5(spark, sf_small.replace("sf0.001", "sf0.01")).where("held_out").collect()
    assert len(rows) > 100 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_training_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "k"), (None, "c", "k")], "doc_id long, text string, score string")
    model = kn.learn(df.limit(0))
    rows = kn.score(df, model).collect()
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in rows)
    assert kn.score(df.limit(0), model).collect() == []


def test_counts_beyond_32_bits_are_kept():
    for top in (0xFFFFFFFF, 0x100000000, 5 << 40):
        counts = np.array([1, 7, top, 3], np.uint64)
        data = kn.narrow(counts)
        assert data.itemsize == (4 if top <= 0xFFFFFFFF else 8)
        assert kn.widened(data.view(np.uint8), 4).tolist() == counts.tolist()
    assert len(kn.widened(kn.narrow(np.zeros(0, np.uint64)).view(np.uint8), 0)) == 0
