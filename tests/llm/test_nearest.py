"""Nearest neighbours against brute force."""

import math
import tracemalloc

import numpy as np
import pytest

from sextant.llm.nearest import nearest, tile

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in usable.items():
        if q % every == 0:
            near = sorted((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in usable.items() if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def compare(spark, rows, **how):
    got = {}
    for r in nearest(spark.createDataFrame(rows, SCHEMA), **how).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute(rows, **how)
    assert {q for q, v in want.items() if v} == set(got)
    for q, near in got.items():
        assert sorted(near) == list(range(1, len(near) + 1))
        mine = [near[i] for i in sorted(near)]
        assert np.allclose([s for _, s in mine], [s for _, s in want[q]], atol=1e-12)
        for (i, s), (j, t) in zip(mine, want[q], strict=True):
            assert i == j or abs(s - t) < 1e-12


def test_random_with_copies(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(700, 16)).astype(np.float32)
    base[100:400] = base[7]  # a large group of copies, queries among them
    compare(spark, [(i, v.tolist()) for i, v in enumerate(base)])


def test_ties_take_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 120)]
    got = nearest(spark.createDataFrame(rows, SCHEMA)).where("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4] and all(r["score"] == 1.0 for r in got)
    got = nearest(spark.createDataFrame(rows, SCHEMA)).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_unusable_vectors_few_candidates_and_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (100, []), (-50, [3.0, 1.0])]
    compare(spark, rows)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("dim", [1024, 1536, 4096])
@pytest.mark.parametrize("values", [(-1, 0, 1), (-1, 1)])
def test_vectors_without_quantisation_error_and_ties(dim, values):
    """Their intervals are as narrow as the rounding bound: products of codes must be exact at any dimension."""
    r = np.random.default_rng(dim)
    base = r.choice(values, size=(40, dim)).astype(float)
    near = np.repeat(base, 20, axis=0)
    for row in near:  # few components differ, so cosines are close or equal
        row[r.integers(0, dim, r.integers(1, 4))] *= -1
    vectors = np.concatenate([base, near])
    ids = r.permutation(len(vectors))
    got = {}
    for q, i, s in tile(ids[:40], vectors[:40], ids, vectors, 5):
        got.setdefault(q, []).append((-s, i))
    norm = (vectors**2).sum(axis=1)
    for k in range(40):
        cosine = (vectors @ vectors[k]) / (np.sqrt(norm) * np.sqrt(norm[k]))
        want = sorted((-c, int(i)) for c, i in zip(cosine, ids, strict=True) if i != ids[k])[:5]
        assert [i for _, i in sorted(got[int(ids[k])])] == [i for _, i in want]


def test_extra_columns_are_ignored(spark):
    rows = [(i, [1.0, float(i)]) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = sorted(map(tuple, nearest(frame).collect()))
    assert sorted(map(tuple, nearest(frame.selectExpr("*", "7 AS id", "'x' AS v", "8 AS dim", "9 AS i", "9 AS j", "true AS q", "1 AS rank", "2 AS score")).collect())) == plain


@pytest.mark.parametrize("shape", ["many candidates", "long near copies"])
def test_memory_of_a_tile_is_bounded(shape):
    """A tile of full size holds a block of products and of exact pairs at once, not all of them."""
    r = np.random.default_rng(11)
    if shape == "many candidates":
        vectors = r.normal(size=(60_000, 8))
    else:
        vectors = r.normal(size=2048) + 1e-6 * r.normal(size=(600, 2048))
    ids, asked = np.arange(len(vectors)), 1024 if shape == "many candidates" else 60
    tracemalloc.start()
    try:
        found = list(tile(ids[:asked], vectors[:asked], ids, vectors, 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 160e6
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in range(0, asked, 20):
        cosine = unit @ unit[q]
        cosine[q] = -2
        got = sorted(((-s, i) for a, i, s in found if a == q))
        assert len(got) == 5 and np.allclose([-s for s, _ in got], np.sort(cosine)[::-1][:5], rtol=0, atol=1e-13)
        assert np.allclose(cosine[[i for _, i in got]], [-s for s, _ in got], rtol=0, atol=1e-13)


@pytest.mark.parametrize("order", ["nearer", "farther"])
def test_candidates_that_come_nearer_or_farther(order):
    """Blocks after the first are cut by the best so far, wherever the nearest stand."""
    angle = np.linspace(1.5, 0.01, 9001)
    vectors = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    vectors = vectors if order == "nearer" else vectors[::-1]
    ids = np.arange(1, len(vectors) + 1)
    got = sorted(tile(np.array([0]), np.array([[3.0, 0.0]]), ids, vectors, 5), key=lambda x: -x[2])
    assert [i for _, i, _ in got] == (ids[::-1][:5].tolist() if order == "nearer" else ids[:5].tolist())


def test_tiles_of_several_batches(spark):
    """Ids repeated over the ends of batches, lengths side by side, doubles and floats."""
    r = np.random.default_rng(12)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(18_000, 16)).astype(np.float32).tolist())]
    rows += [(20_000 + i, v) for i, v in enumerate(r.normal(size=(400, 3)).astype(np.float32).tolist())]
    rows += [row for row in rows if row[0] % 7 == 0] * 2
    compare(spark, rows, every=2000)
    wide = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "CAST(embedding AS array<double>) AS embedding")
    plain = nearest(spark.createDataFrame(rows, SCHEMA), every=2000)
    assert sorted(map(tuple, nearest(wide, every=2000).collect())) == sorted(map(tuple, plain.collect()))
