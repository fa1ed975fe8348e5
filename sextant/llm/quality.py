"""Quality classifier by positive-unlabelled learning (operator 2).

A logistic model over statistics of the whole text minimises the non-negative unbiased risk
prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): trusted positives are all documents labelled of quality
1, the unlabelled are all texts without a label; documents labelled 0 teach nothing. With the logistic
loss the risk without its bound is convex in the weights, so a few Newton steps find its minimum, each a pass
over the stored statistics; a step that would make the negatives' risk negative is halved until it
doesn't. After STEPS passes the best weights so far are taken, and a warning says that their risk may not be the least
(on the given tables the bound acts, and ends the steps). The class prior is estimated from both samples: a first model tells positives from unlabelled
texts, and no set of its scores may hold a smaller share of the unlabelled than prior times that of
the positives. Only the text makes a score; nothing is sampled, tasks send sums.

Rows with crc32(doc_id as text) mod 5 = 0 are held out. A null or empty text is scored as the empty
one; null ids are never learnt from and count as not held out; without any positive or unlabelled text
the score is 1/2. Repeated labels of one id: the smallest quality counts; repeated rows count as often
as they occur. A task's memory follows the longest text (about 300 bytes a byte). Extra columns pass
through, clashing ones are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import Words, chunks
from ._runtime import materialise, prepare, release, replaced, trim, with_columns

FOLDS, THRESHOLD = 5, 0.3
#: Passes over the statistics for one model, and weight of the squared weights in the risk: at least, and times the rows.
STEPS, DECAY, SPREAD = 16, 1e-4, 10
#: The prior is read off sets that hold this share of the positives at least, so that chance doesn't make it.
POSITIVES = 0.5


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers for each text."""
    words = Words(texts)
    n = len(texts)
    # how much of a text each kind of byte makes up
    of = np.repeat(np.arange(n), np.diff(words.text_start))
    counts = np.bincount(of * 256 + words.data, minlength=n * 256).reshape(n, 256).astype(float)
    counts[:, 10] -= 1  # the line end that joins texts
    size = np.maximum(counts.sum(axis=1), 1)
    ascii_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    kinds = [counts[:, 65:91].sum(1), counts[:, 97:123].sum(1), counts[:, 48:58].sum(1), counts[:, 128:].sum(1), counts[:, 10], counts[:, 32], counts[:, :9].sum(1) + counts[:, 14:32].sum(1)]
    shares = np.sqrt(np.stack(kinds + [counts[:, b] for b in ascii_marks], axis=1) / size[:, None])
    # words: how many, how long, how many distinct, how many begin or end with a mark or a capital
    n_words = np.diff(words.first)
    word_of = np.repeat(np.arange(n), n_words)
    some = np.maximum(n_words, 1)
    mean = lambda x: np.bincount(word_of, weights=x, minlength=n) / some
    length = (words.end - words.start).astype(float)
    average = mean(length)
    first, last = words.data[words.start], words.data[words.end - 1]
    capital = (first >= 65) & (first <= 90)
    letter = lambda b: ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    by = np.lexsort((words.hash, word_of))
    new = np.ones(len(by), bool)
    new[1:] = (words.hash[by][1:] != words.hash[by][:-1]) | (word_of[by][1:] != word_of[by][:-1])
    distinct = np.bincount(word_of[by][new], minlength=n) / some
    pairs = words.shingles(3)
    inside = word_of[: len(pairs)] == word_of[2:] if len(pairs) else np.zeros(0, bool)
    pairs, pair_of = pairs[inside], word_of[: len(inside)][inside]
    by = np.lexsort((pairs, pair_of))
    new = np.ones(len(by), bool)
    new[1:] = (pairs[by][1:] != pairs[by][:-1]) | (pair_of[by][1:] != pair_of[by][:-1])
    fresh = np.bincount(pair_of[by][new], minlength=n) / np.maximum(np.bincount(pair_of, minlength=n), 1)
    lines = counts[:, 10] + 1
    rest = [np.log1p(n_words), np.log1p(size), average, np.sqrt(np.maximum(mean(length**2) - average**2, 0)), distinct, fresh, mean(capital), mean(~letter(first)), mean(~letter(last)), np.log1p(n_words / lines), np.log1p(lines)]
    return np.column_stack([shares, *rest])


@dataclass
class Model:
    """Standardised features and their squares under one linear function."""

    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        return np.concatenate([z, z * z], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(x), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weight + self.bias, -50, 50)))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def minimised(sums, width: int, prior: float) -> np.ndarray:
    """The weights (the last the bias) of least prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

    sums(w): the number of positives and of unlabelled, of the positives the sums of x and of the loss as
    negatives, and of the unlabelled those of the loss, its gradient and its Hessian, at w. As the losses of
    a positive as negative and as positive differ by its score, the risk is mean_u(loss) - prior * mean_p(score).
    """
    w, best, before = np.zeros(width), np.zeros(width), np.inf
    for _ in range(STEPS):
        n_p, n_u, x_p, loss_p, loss_u, grad, hess = sums(w)
        weight = DECAY + SPREAD / (n_p + n_u)
        penalty = weight / 2 * (w[:-1] ** 2).sum()
        risk = loss_u / n_u - prior * (x_p @ w) / n_p + penalty
        if risk > before or loss_u / n_u < prior * loss_p / n_p:
            if np.abs(w - best).max() < 1e-7:
                return best
            w = (w + best) / 2
            continue
        if before - risk < 1e-9:
            return w
        best, before = w, risk
        decay = np.append(np.full(width - 1, weight), 1e-9)
        w = w - np.linalg.solve(hess / n_u + np.diag(decay), grad / n_u - prior * x_p / n_p + decay * w)
    warnings.warn(f"the risk fell to {before:.6g} in {STEPS} passes and may fall further", RuntimeWarning, stacklevel=2)
    return best


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of the unlabelled that can be positives, from both histograms of one score."""
    p, u = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (positive, unlabelled))
    some = p >= POSITIVES
    return float(np.clip((u[some] / p[some]).min(), 0.01, 0.99)) if some.any() else 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


WIDTH = features([b""]).shape[1]
#: Tasks that add up the sums of all others before the driver does.
ADDERS = 16


def statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """x (the features) and positive of every text that may be learnt from."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                x = features(texts).astype(np.float32)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), rows], names=["id", "x"])
        trim()

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text").where(~held_out(F.col("id")))
    found = own.mapInArrow(run, "id long, x array<float>").join(known, "id", "left")
    return found.where("quality IS NULL OR quality = 1").select("x", F.col("quality").isNotNull().alias("positive"))


def total(rows: DataFrame, part, size: int) -> np.ndarray:
    """The sum of part(x, positive) over all tasks, as size numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += part(batch.column("x").flatten().to_numpy().reshape(-1, WIDTH).astype(float), batch.column("positive").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for blob in batch.column("sums").to_pylist():
                out += np.frombuffer(blob)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    added = rows.mapInArrow(run, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(bytes(r["sums"])) for r in added.collect()), np.zeros(size))


def fit(rows: DataFrame) -> tuple[Model, float]:
    """The model and the class prior from x and positive of all rows."""
    none = np.zeros(0)
    moments = total(rows, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(axis=0), (x**2).sum(axis=0)]), 2 + 2 * WIDTH)
    n, n_p = moments[:2]
    if not 0 < n_p < n:
        return Model(none, none, none, 0.5), 0.5
    center = moments[2 : 2 + WIDTH] / n
    model = Model(center, np.maximum(np.sqrt(np.maximum(moments[2 + WIDTH :] / n - center**2, 0)), 1e-4), none, 0.0)
    width = 2 * WIDTH + 1

    def sums(w: np.ndarray) -> tuple:
        def part(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            x = np.column_stack([model.design(x), np.ones(len(x))])
            z = x @ w
            chance = 1 / (1 + np.exp(-np.clip(z[~p], -500, 500)))
            u = x[~p]
            hess = (u * (chance * (1 - chance))[:, None]).T @ u
            return np.concatenate([[p.sum(), (~p).sum(), softplus(z[p]).sum(), softplus(z[~p]).sum()], x[p].sum(axis=0), chance @ u, hess.ravel()])

        out = total(rows, part, 4 + 2 * width + width * width)
        return out[0], out[1], out[4 : 4 + width], out[2], out[3], out[4 + width : 4 + 2 * width], out[4 + 2 * width :].reshape(width, width)

    # the positives as half of all: a model that only tells them from the unlabelled
    w = minimised(sums, width, 0.5)

    def histograms(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        chance = 1 / (1 + np.exp(-np.clip(model.design(x) @ w[:-1] + w[-1], -500, 500)))
        place = np.minimum((chance * 1000).astype(int), 999)
        return np.concatenate([np.bincount(place[p], minlength=1000), np.bincount(place[~p], minlength=1000)])

    prior = estimated_prior(*total(rows, histograms, 2000).reshape(2, 1000))
    w = minimised(sums, width, prior)
    model.weight, model.bias = w[:-1], float(w[-1])
    return model, prior


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, float]:
    """The model and the class prior; docs: doc_id, text; labels: doc_id, quality."""
    prepare(docs.sparkSession)
    rows = materialise(statistics(docs, labels), "statistics")
    found = fit(rows)
    release(rows)
    return found


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [shared.value.score(features(t)) for _, t in chunks(batch.column("text").cast(pa.binary()).to_pylist())]
            yield replaced(batch, {name: pa.array(np.concatenate([np.zeros(0), *runs]))})
        trim()

    return docs.mapInArrow(run, with_columns(docs.schema, [(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted."""
    prepare(docs.sparkSession)
    model, _ = learn(docs, labels)
    out = score(docs, model)
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
