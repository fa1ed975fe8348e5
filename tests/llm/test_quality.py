"""The classifier: held-out accuracy, the risk, and odd rows."""

import zlib

import numpy as np

from sextant.llm import quality


def test_held_out_accuracy(spark, sf_small):
    d = sf_small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.op2(spark, d).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    test = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(test) > 50 and np.mean([p == y for p, y in test]) > 0.95


def test_learns_only_from_its_folds(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    one, two = (quality.classify(docs, x).orderBy("doc_id").select("score").toPandas() for x in (labels, other))
    assert np.allclose(one, two)


def risk_of(w, p, u, prior, weight):
    """The unbiased risk, its gradient, and the negatives' part; rows in memory."""
    softplus = lambda z: np.logaddexp(0, z)
    decay = np.append(np.full(len(w) - 1, weight), 1e-9)
    positives, negatives = prior * softplus(-(p @ w)).mean(), softplus(u @ w).mean() - prior * softplus(p @ w).mean()
    chance = 1 / (1 + np.exp(-(u @ w)))
    grad = -prior * p.mean(axis=0) + chance @ u / len(u) + decay * w
    return positives + negatives + weight / 2 * (w[:-1] ** 2).sum(), grad, negatives, (u * (chance * (1 - chance))[:, None]).T @ u / len(u) + np.diag(decay)


def plain_fit(positive, unlabelled, prior):
    """Newton steps from zero over rows in memory, halved where the risk grows or the negatives' part is negative."""
    both = np.concatenate([positive, unlabelled])
    model = quality.Model(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-4), np.zeros(0), 0.0)
    p, u = (np.column_stack([model.design(x), np.ones(len(x))]) for x in (positive, unlabelled))
    weight, w, least = quality.DECAY + quality.SPREAD / len(both), np.zeros(p.shape[1]), np.inf
    good = w
    for _ in range(quality.STEPS):
        risk, grad, negatives, hess = risk_of(w, p, u, prior, weight)
        if risk <= least and negatives >= 0:
            if least - risk < 1e-9:
                return model, w
            good, least = w, risk
            w = w - np.linalg.solve(hess, grad)
        elif np.abs(w - good).max() < 1e-7:
            break
        else:
            w = (w + good) / 2
    return model, good


def rows_of(spark, positive, unlabelled):
    rows = [(x.tolist(), True) for x in positive] + [(x.tolist(), False) for x in unlabelled]
    return spark.createDataFrame(rows, "x array<float>, positive boolean").repartition(5)


def test_scores_against_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    usable = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    x = {i: quality.features([texts[i]])[0].astype(np.float32).astype(float) for i in texts}
    positive, unlabelled = (np.stack([x[i] for i in usable if labels.get(i) == y]) for y in (1, None))
    fitted, prior = quality.learn(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    model, w = plain_fit(positive, unlabelled, prior)
    assert np.allclose(fitted.center, model.center) and np.allclose(fitted.weight, w[:-1], atol=1e-5)
    want = 1 / (1 + np.exp(-(model.design(np.stack(list(x.values()))) @ w[:-1] + w[-1])))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, fitted).collect()}
    assert np.allclose([got[i] for i in x], want, atol=1e-6)


def test_prior_and_risk(spark, monkeypatch):
    monkeypatch.setattr(quality, "WIDTH", 3)
    r = np.random.default_rng(0)
    for share in (0.75, 0.4):
        positive, unlabelled = r.normal(2, 1, (2000, 3)), np.concatenate([r.normal(2, 1, (int(4000 * share), 3)), r.normal(-2, 1, (int(4000 * (1 - share)), 3))])
        model, prior = quality.fit(rows_of(spark, positive, unlabelled))
        assert abs(prior - share) < 0.06
        p, u = (np.column_stack([model.design(x.astype(np.float32).astype(float)), np.ones(len(x))]) for x in (positive, unlabelled))
        _, grad, negatives, _ = risk_of(np.append(model.weight, model.bias), p, u, prior, quality.DECAY + quality.SPREAD / (len(p) + len(u)))
        assert negatives < 1e-3 or np.abs(grad).max() < 1e-4  # the least risk, or as far as its bound lets it
        good, bad = model.score(r.normal(2, 1, (500, 3))), model.score(r.normal(-2, 1, (500, 3)))
        assert (good > 0.5).mean() > 0.95 and (bad < 0.5).mean() > 0.95


def test_negatives_risk_is_not_negative(spark, monkeypatch):
    """With a prior that is far too large the bound acts."""
    monkeypatch.setattr(quality, "WIDTH", 3)
    monkeypatch.setattr(quality, "estimated_prior", lambda p, u: 0.95)
    r = np.random.default_rng(1)
    positive, unlabelled = r.normal(1, 1, (500, 3)), r.normal(-1, 1, (500, 3))
    model, _ = quality.fit(rows_of(spark, positive, unlabelled))
    loss = lambda x: np.logaddexp(0, model.design(x) @ model.weight + model.bias).mean()
    assert loss(unlabelled) >= 0.95 * loss(positive) - 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "text", "c"), (3, "x " * 5000, "d"), (3, "x " * 5000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2]
    assert quality.classify(docs.limit(0), labels.limit(0)).collect() == []
