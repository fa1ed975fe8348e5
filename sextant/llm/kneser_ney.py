"""Interpolated modified Kneser-Ney bigram model (operator 5).

Counts are gathered in Spark and stored as sorted hash arrays in the shared folder; workers map them
and score texts. Tokens are lower-cased (A-Z) words and one end a text; a text begins in a start
context. Tables: words (sorted 64-bit hash, count, continuation count, and how many followers were
seen once, twice, more often) and bigrams (sorted bijective mix of the two word ids, count), each cut
into shards by hash, so that the number of shards follows the input and no shard outgrows a task.

p(w|v) = (c(vw) - D(c)) / c(v) + g(v) p(w); p(w) = (t(w) - D'(t)) / T + g' / (V + 1), with t the
number of distinct words before w, T their sum, V the distinct tokens, and the discounts of Chen and
Goodman from the counts of counts. A word never seen has t = 0; a context never seen leaves p(w).

Null and empty texts are one end token. Null ids are scored, not learnt from, and not held out.
Repeated rows count as often as they occur. The base score is an add-one unigram model's. Extra
columns pass through, clashing ones are replaced. More than 2**32 - 2 distinct tokens are an error. Texts
are counted and scored whole, so a task's memory follows the longest one (about 100 bytes a byte).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import Words, chunks, mix
from ._runtime import prepare, replaced, scratch_path, with_columns
from ._store import map_array, write_array

FOLDS, HELD_OUT = 7, 2
END, START = np.uint64(0x0123456789ABCDEF), 0xFFFFFFFF
#: Tokens that one shard of a table gets on average, and those a task holds before it passes them on.
SHARD_TOKENS, HELD = 1_000_000, 2_000_000
BLOB = "shard int, n long, keys binary, counts binary"


def squeeze(numbers: np.ndarray) -> bytes:
    """Sorted or small numbers: differences, byte plane by byte plane, by zstd."""
    step = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, n * 8, "zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts (one column or more)."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token hashes of the texts, each with its end; the text of each token; whether it begins a text."""
    n = len(words.first) - 1
    size = np.diff(words.first) + 1
    end = np.cumsum(size) - 1
    hashes = np.full(int(size.sum()), END)
    hashes[np.delete(np.arange(len(hashes)), end)] = words.hash
    begins = np.zeros(len(hashes), bool)
    begins[end - size + 1] = True
    return hashes, np.repeat(np.arange(n), size), begins


class Held:
    """Keys and counts of a task, passed on by shard when many have gathered."""

    def __init__(self, bits: int, shard_of):
        self.bits, self.shard_of = bits, shard_of
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(summed(keys, counts))
        self.size += len(self.parts[-1][0])
        if self.size > HELD:
            self.parts = [summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
            if self.size > HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            shard = self.shard_of(keys)
            order = np.argsort(shard.astype(np.uint16) if self.bits <= 16 else shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange((1 << self.bits) + 1))
            for s in np.flatnonzero(np.diff(cut)):
                own = order[cut[s] : cut[s + 1]]
                yield blob_row(int(s), keys[own], counts[own])
        self.clear()


def blob_row(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    flat = counts.astype(np.uint64).reshape(len(keys), -1).T.ravel()
    packed = pa.compress(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([squeeze(keys)], pa.binary()), pa.array([packed], pa.binary())], names=["shard", "n", "keys", "counts"])


def blob_rows(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each shard's keys and summed counts; a task's rows must be in the order of shard."""
    shard, parts, size = None, [], 0

    def done():
        return shard, *summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    for batch in batches:
        for s, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "keys", "counts")), strict=True):
            if s != shard and parts:
                yield done()
                parts, size = [], 0
            shard = s
            planes = np.frombuffer(pa.decompress(counts, n * columns * 8, "zstd"), np.uint8).reshape(8, n * columns)
            parts.append((unsqueeze(keys, n), np.ascontiguousarray(planes.T).view(np.uint64).reshape(columns, n).T.copy()))
            size += n
            if size > 2 * HELD:
                parts = [done()[1:]]
                size = len(parts[0][0])
    if parts:
        yield done()


def by_shard(rows: DataFrame, bits: int) -> DataFrame:
    """All rows of a shard in one task, in order; rows are one a task and shard."""
    return rows.repartition(min(1 << bits, 1 << 15), "shard").sortWithinPartitions("shard")


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes each where all fit, else in eight."""
    return counts.astype(np.uint32 if not len(counts) or counts.max() <= 0xFFFFFFFF else np.uint64)


def widened(data: np.ndarray, n: int) -> np.ndarray:
    """The n counts that narrow() made bytes of."""
    return data.view(np.uint64 if len(data) == 8 * n else np.uint32) if n else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Where the arrays are, and the numbers that hold for the whole corpus."""

    folder: str
    word_bits: int = 0
    pair_bits: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # the first id of each shard
    tokens: int = 0
    distinct: int = 0
    texts: int = 0
    pairs: int = 0
    discounts: tuple = ((0.0,) * 4, (0.0,) * 4)  # of bigrams, of words; for counts 0, 1, 2, 3 and more
    lower_weight: float = 1.0
    start: tuple = (0, 0, 0)  # followers of the start context by count
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def array(self, name: str, shard: int, dtype) -> np.ndarray:
        key = (name, shard)
        if key not in self._open:
            self._open[key] = map_array(f"{self.folder}/{name}-{shard}", dtype)
        return self._open[key]

    def find(self, name: str, bits: int, hashes: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
        """For sorted hashes, by shard: the shard, the slice of hashes, their places, and which were found."""
        shards = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(shards, np.arange((1 << bits) + 1))
        for s in np.flatnonzero(np.diff(cut)):
            own = slice(int(cut[s]), int(cut[s + 1]))
            table = self.array(name, int(s), np.uint64)
            place = np.searchsorted(table, hashes[own])
            found = place < len(table)
            found[found] = table[place[found]] == hashes[own][found]
            yield int(s), own, place, found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of sorted hashes, -1 for words not learnt."""
        out = np.full(len(hashes), -1, np.int64)
        for s, own, place, found in self.find("hash", self.word_bits, hashes):
            out[own] = np.where(found, place + self.offsets[s], -1)
        return out

    def word_numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the five numbers of each word: count, continuations, followers by count."""
        ids, numbers = np.full(len(hashes), -1, np.int64), np.zeros((len(hashes), 5), np.int64)
        for s, own, place, found in self.find("hash", self.word_bits, hashes):
            ids[own] = np.where(found, place + self.offsets[s], -1)
            at = place[found]
            some = np.zeros((len(place), 5), np.int64)
            some[found, 0] = self.array("count", s, np.uint64)[at]
            some[found, 1:] = self.array("stats", s, np.uint64).reshape(-1, 4)[at]
            numbers[own] = some
        return ids, numbers

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of bigram keys, 0 for those not learnt."""
        hashes = mix(keys)
        order = np.argsort(hashes)
        out = np.zeros(len(keys), np.int64)
        for s, own, place, found in self.find("pair", self.pair_bits, hashes[order]):
            some = np.zeros(len(place), np.int64)
            some[found] = widened(self.array("times", s, np.uint8), len(self.array("pair", s, np.uint64)))[place[found]]
            out[order[own]] = some
        return out

    def log_probabilities(self, words: Words) -> tuple[np.ndarray, ...]:
        """For each token: its text, log10 of the model's and of the base probability, whether it is known."""
        hashes, text, begins = tokens_of(words)
        unique, back = np.unique(hashes, return_inverse=True)
        ids, numbers = self.word_numbers(unique)
        before = np.roll(back, 1)
        c_context = np.where(begins, self.texts, numbers[before, 0])
        followers = np.where(begins[:, None], np.array(self.start), numbers[before][:, 2:])
        context, own = np.where(begins, START, ids[before]), ids[back]
        pair = np.zeros(len(back), np.int64)
        known = np.flatnonzero((context >= 0) & (own >= 0))
        keys, key_back = np.unique((context[known].astype(np.uint64) << np.uint64(32)) | own[known].astype(np.uint64), return_inverse=True)
        pair[known] = self.pair_counts(keys)[key_back]
        upper, lower = (np.array(d) for d in self.discounts)
        t = numbers[:, 1]
        p_word = np.maximum(t - lower[np.minimum(t, 3)], 0) / max(self.pairs, 1) + self.lower_weight / (self.distinct + 1)
        some = np.maximum(c_context, 1)
        p = np.maximum(pair - upper[np.minimum(pair, 3)], 0) / some + np.where(c_context > 0, followers @ upper[1:] / some, 1.0) * p_word[back]
        base = np.log10((numbers[:, 0] + 1) / (self.tokens + self.distinct + 1))
        return text, np.log10(p), base[back], own >= 0


def discounts(n: np.ndarray) -> tuple[float, float, float, float]:
    """Chen and Goodman's for counts 0, 1, 2, 3+ from n[1..4]; where a count of counts is 0, half the count."""
    out = [0.0]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if y is not None and n[k] and n[k + 1] else k / 2
        out.append(min(max(d, 0.0), float(k)))
    return tuple(out)


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Count the bigrams of all texts of docs and write the model's arrays."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(text).alias("text"))
    texts, size = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # the number of shards follows the input, so that each stays within a task
    bits = max(0, int(np.ceil(np.log2(max(1, size / 6 / SHARD_TOKENS)))))
    model = Model(scratch_path(spark, "ngrams"), word_bits=bits, pair_bits=bits, texts=texts)
    folder = model.folder
    shard_of = lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        for batch in batches:
            for _, run in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                yield Words(run)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(bits, shard_of)
        for words in runs(batches):
            hashes = tokens_of(words)[0]
            yield from held.add(hashes, np.ones(len(hashes), np.uint64))
        yield from held.flush()

    def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in blob_rows(batches, 1):
            write_array(f"{folder}/hash-{s}", keys)
            write_array(f"{folder}/count-{s}", counts[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["shard", "n", "total"])

    found = by_shard(docs.mapInArrow(count_words, BLOB), bits).mapInArrow(keep_words, "shard int, n long, total long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in found:
        sizes[r["shard"]] = r["n"]
    for s in np.flatnonzero(sizes == 0).tolist():
        for name in ("hash", "count", "stats"):
            write_array(f"{folder}/{name}-{s}", np.zeros(0, np.uint64))
    model.offsets = np.concatenate([[0], np.cumsum(sizes)])
    model.tokens, model.distinct = sum(r["total"] for r in found), int(sizes.sum())
    if model.distinct >= START:
        raise ValueError("too many distinct tokens for 32-bit ids")
    words_only = spark.sparkContext.broadcast(model)  # a number a shard
    pair_shard = lambda keys: shard_of(mix(keys))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(bits, pair_shard)
        for words in runs(batches):
            hashes, _, begins = tokens_of(words)
            unique, back = np.unique(hashes, return_inverse=True)
            ids = words_only.value.ids(unique)[back].astype(np.uint64)
            before = np.where(begins, np.uint64(START), np.roll(ids, 1))
            yield from held.add((before << np.uint64(32)) | ids, np.ones(len(ids), np.uint64))
        yield from held.flush()

    def keep_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write each shard of bigrams; pass on what they say of their two words, and counts of counts as shard -1."""
        offsets = words_only.value.offsets
        for s, keys, counts in blob_rows(batches, 1):
            counts = counts[:, 0]
            hashes = mix(keys)
            order = np.argsort(hashes)
            write_array(f"{folder}/pair-{s}", hashes[order])
            write_array(f"{folder}/times-{s}", narrow(counts[order]))
            context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
            kind = np.minimum(counts, 3).astype(np.int64)
            of_counts = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:6]
            started = context == START
            totals = np.concatenate([of_counts, np.bincount(kind[started], minlength=4)[1:4]])
            yield blob_row(-1, np.arange(8, dtype=np.uint64), totals)
            numbers = np.zeros((len(keys), 4), np.uint64)
            numbers[np.arange(len(keys)), kind] = 1
            ones = np.zeros((len(keys), 4), np.uint64)
            ones[:, 0] = 1
            ids, numbers = summed(np.concatenate([context[~started], word]), np.concatenate([numbers[~started], ones]))
            cut = np.searchsorted(ids, offsets.astype(np.uint64))
            for w in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(int(cut[w]), int(cut[w + 1]))
                yield blob_row(w, ids[own] - np.uint64(offsets[w]), numbers[own])

    def keep_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum what the bigrams said of each word, and count the continuation counts."""
        totals = np.zeros(14, np.int64)
        parted = _by_kind(batches)
        for s, keys, counts in parted:
            if s < 0:
                totals[keys.astype(np.int64)] += counts[:, 0].astype(np.int64)
                continue
            stats = np.zeros((int(sizes[s]), 4), np.uint64)
            stats[keys.astype(np.int64)] = counts
            write_array(f"{folder}/stats-{s}", stats)
            t = stats[:, 0].astype(np.int64)
            totals[8:13] += np.bincount(np.minimum(t, 5), minlength=6)[1:6]
            totals[13] += int(t.sum())
        yield pa.RecordBatch.from_arrays([pa.array([totals.tolist()], pa.list_(pa.int64()))], names=["totals"])

    said = by_shard(docs.mapInArrow(count_pairs, BLOB), bits).mapInArrow(keep_pairs, BLOB)
    totals = np.zeros(14, np.int64)
    for r in by_shard(said, bits).mapInArrow(keep_stats, "totals array<long>").collect():
        totals += np.array(r["totals"])
    n, t = np.concatenate([[0], totals[:5]]), np.concatenate([[0], totals[8:13]])
    model.discounts = (discounts(n), discounts(t))
    model.start, model.pairs = tuple(int(x) for x in totals[5:8]), int(totals[13])
    lower = np.array(model.discounts[1])
    freed = lower[1] * t[1] + lower[2] * t[2] + lower[3] * t[3:].sum()
    model.lower_weight = float(freed / model.pairs) if model.pairs else 1.0
    return model


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """blob_rows over rows of one column (shard -1, which come first) and of four."""

    def some(wanted: bool, source: Iterator[pa.RecordBatch], rest: list) -> Iterator[pa.RecordBatch]:
        for batch in source:
            minus = np.asarray(batch.column("shard").to_numpy() < 0)
            if wanted and not minus.all():
                rest.append(batch.filter(pa.array(~minus)))
            yield batch.filter(pa.array(minus)) if wanted else batch
            if wanted and not minus.all():
                return

    rest: list[pa.RecordBatch] = []
    yield from blob_rows(some(True, batches, rest), 1)

    def others() -> Iterator[pa.RecordBatch]:
        yield from rest
        yield from batches

    yield from blob_rows(others(), 4)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a shard; the arrays are mapped
    new = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            parts = []
            for _, some in chunks(batch.column(text).cast(pa.binary()).to_pylist()):
                of, p, base, known = own.log_probabilities(Words(some))
                total = lambda x: np.bincount(of, weights=x, minlength=len(some))  # noqa: B023, E731
                parts.append(np.stack([np.bincount(of, minlength=len(some)), total(known), total(base), total(p)]))
            n, known, base, p = np.concatenate([np.zeros((4, 0)), *parts], axis=1)
            columns = [pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), own.tokens)), pa.array(base), pa.array(p)]
            yield replaced(batch, dict(zip([x for x, _ in new], columns, strict=True)))

    return docs.mapInArrow(run, with_columns(docs.schema, new))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs.where(fold(F.col("doc_id")) != HELD_OUT))
    out = score(docs, model).drop("text")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
