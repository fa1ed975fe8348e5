"""Byte-level BPE encoding and decoding (operator 6).

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are entries
themselves; any other is merged by a heap of pairs over linked bytes. Ids equal those of the
tiktoken library's encode_ordinary. Nulls encode as empty; an empty text has no ids; texts of any
length are read whole. Extra columns pass through; input columns named like an output are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import mix
from ._runtime import prepare, replaced, trim, with_columns

#: Pre-tokens whose ids a worker remembers, and the longest of them; beyond, it forgets all.
CACHE_ENTRIES, CACHE_LENGTH = 600_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 bytes and a rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys in n slots, the key kept to verify."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 3):
        keys = list(ranks)
        n = len(keys)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(hashes)) < n:
            raise ValueError("two vocabulary entries share a 64-bit hash")
        self.size, self.buckets = n, max(1, n // per_bucket)
        self.displace = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * n
        self.ids = np.zeros(n, np.int32)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        members = np.split(order, ends[:-1])
        taken = np.zeros(n, bool)
        for b in sorted(range(self.buckets), key=lambda i: -len(members[i])):
            own = members[b]
            if len(own) < 2:
                break
            seed, tries = 1, 8
            while True:
                seeds = np.arange(seed, seed + tries, dtype=np.uint64)
                slots = np.sort(self._slots(hashes[own][None, :], seeds[:, None]), axis=1)
                fit = np.flatnonzero(~taken[slots].any(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1))
                if len(fit):
                    seed += int(fit[0])
                    slots = self._slots(hashes[own], seed)
                    break
                seed, tries = seed + tries, min(4096, tries * 4)
            self.displace[b] = seed
            self._put(own, slots, keys, ranks, taken)
        free = iter(np.flatnonzero(~taken).tolist())
        for b in range(self.buckets):
            if len(members[b]) == 1:  # a lone key names its slot outright
                slot = next(free)
                self.displace[b] = -slot - 1
                self._put(members[b], np.array([slot]), keys, ranks, taken)

    def _slots(self, hashes: np.ndarray, seed) -> np.ndarray:
        return (mix(hashes ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.size)).astype(np.int64)

    def _put(self, own, slots, keys, ranks, taken) -> None:
        taken[slots] = True
        for i, slot in zip(own.tolist(), slots.tolist(), strict=True):
            self.keys[slot], self.ids[slot] = keys[i], ranks[keys[i]]

    def find(self, tokens: list[bytes]) -> list[int]:
        """The id of each token, or -1."""
        if not self.size or not tokens:
            return [-1] * len(tokens)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
        d = self.displace[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, self._slots(hashes, np.maximum(d, 0)))
        keys, ids = self.keys, self.ids[slots].tolist()
        return [i if keys[s] == t else -1 for t, s, i in zip(tokens, slots.tolist(), ids, strict=True)]


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, the leftmost of equals, is merged until none is left."""
    n, get = len(token), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # links: where each part ends, and the one before it
    rank_at = [get(token[i : i + 2], -1) for i in range(n - 1)]
    rank_at.append(-1)
    heap = [r * n + i for i, r in enumerate(rank_at) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if rank_at[i] != r:
            continue  # one of the two has been merged meanwhile
        j = end[i]
        k = end[i] = end[j]
        rank_at[j] = -1
        rank_at[i] = r = get(token[i : end[k]], -1) if k < n else -1
        if k < n:
            before[k] = i
        if r >= 0:
            heapq.heappush(heap, r * n + i)
        h = before[i]
        if h >= 0:
            rank_at[h] = r = get(token[h:k], -1)
            if r >= 0:
                heapq.heappush(heap, r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """The coder that workers hold."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.table = PerfectHash(ranks)
        self.bytes_of = np.full(max(ranks.values(), default=-1) + 1, None, object)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.ready()

    def ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "cache")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.ready()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a pre-token that a worker remembers is not looked up again."""
        found = [self.split(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {}
        ids = self.cache
        missing = list(set().union(*found).difference(ids))
        if missing:
            raw = [t.encode() for t in missing]
            for text_token, token, i in zip(missing, raw, self.table.find(raw), strict=True):
                ids[text_token] = (i,) if i >= 0 else tuple(merge(token, self.ranks))
        out = [np.fromiter(chain.from_iterable(map(ids.__getitem__, f)), np.int32) for f in found]
        for t in missing:
            if len(t) > CACHE_LENGTH:
                del ids[t]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(self.bytes_of[np.asarray(ids, np.int32)].tolist())


def _with_columns(df: DataFrame, codec: Codec, work, new: list[tuple[str, T.DataType]]) -> DataFrame:
    """df with the columns that work(coder, batch) gives; a worker's tables have the vocabulary's size."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield replaced(batch, dict(zip([n for n, _ in new], work(shared.value, batch), strict=True)))
        trim()

    return df.mapInArrow(run, with_columns(df.schema, new))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def encode(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each text as array<int>."""
    work = lambda coder, batch: [_lists(coder.encode_all(batch.column(text).to_pylist()))]
    return _with_columns(df, codec, work, [(ids, T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, codec: Codec, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that each array of ids stands for; a null array gives no bytes."""

    def work(coder: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        arrays = (batch.column(ids)[i].values for i in range(batch.num_rows))
        return [pa.array([coder.decode(a.to_numpy()) if a is not None else b"" for a in arrays], pa.binary())]

    return _with_columns(df, codec, work, [(decoded, T.BinaryType())])


def round_trip(df: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each text and the bytes decoded from them, in one pass."""

    def work(coder: Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        rows = coder.encode_all(batch.column(text).to_pylist())
        return [_lists(rows), pa.array([coder.decode(r) for r in rows], pa.binary())]

    return _with_columns(df, codec, work, [(ids, T.ArrayType(T.IntegerType())), (decoded, T.BinaryType())])


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), " ")


_codecs: dict[tuple[str, str], Codec] = {}


def public_codec(name: str = "byte_bpe_50k.tiktoken") -> Codec:
    """The codec of an installed public tokenizer, built once a process."""
    import public_tokenizers

    key = (public_tokenizers.path(name), public_tokenizers.PATTERN)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(key[0]), key[1])
    return _codecs[key]


def digests(docs: DataFrame, codec: Codec | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    codec = codec or public_codec()
    out = round_trip(docs.select("doc_id", "text"), codec).drop("text")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
