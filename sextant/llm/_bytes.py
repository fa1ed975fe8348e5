"""Vectorised hashing of words and windows over the bytes of many texts at once.

Words are hashed eight bytes at a time. A prefix sum of table[byte] * BASE**position (modulo 2**64) gives
the hash of any byte range in constant time: (sum[end] - sum[start]) * BASE**-start, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 5
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: 0x20 and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(base: int, n: int, name: str) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64, kept for the next call."""
    found = _powers.get(name)
    if found is None or len(found) < n:
        size = max(n, 1 << 16)
        found = np.empty(size, np.uint64)
        found[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            found[done : done + step] = found[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _powers[name] = found
    return found[:n]


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * powers(BASE, len(data), "base"), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range, its length included."""
    inverse = powers(pow(BASE, -1, 1 << 64), len(sums), "inverse")
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def chunks(texts: Iterable[bytes | None], size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about size bytes, each with the index of its first; null is empty."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or b"")
        total += len(held[-1]) + 1
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


#: A longer word is hashed by itself; others eight bytes at a time, all together.
LONGEST = 256
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word, its length included."""
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))  # the eight bytes from each byte on
    some, at = np.flatnonzero(size <= LONGEST), 0
    while len(some):
        part = eight[start[some] + at] & _LOW[np.minimum(size[some] - at, 8)]
        out[some] = mix(out[some] ^ part) * np.uint64(0x9FB21C651E98DF25)
        at += 8
        some = some[size[some] > at]
    for i in np.flatnonzero(size > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


class Words:
    """The words of a run of texts: hashes, and where each text's (or line's) words begin."""

    def __init__(self, texts: list[bytes], separator: np.ndarray = SEPARATOR):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = np.concatenate([[False], ~separator[self.data]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]  # the last byte is a separator
        self.hash = word_hashes(LOWER[self.data], self.start, self.end)
        self.first = np.searchsorted(self.start, self.text_start)

    def shingles(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k-1 of a text don't count."""
        n = max(0, len(self.hash) - k + 1)
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * np.uint64(0xC2B2AE3D27D4EB4F) + self.hash[i : i + n]
        return mix(total)

    def whole(self, a: int, b: int) -> np.ndarray:
        """One hash for the words a to b, for texts of fewer words than a shingle has."""
        total, n = 0, int(b - a)
        for h in self.hash[a:b].tolist():
            total = (total * 0xA0761D6478BD642F + h + n) & _MASK
        return mix(np.array([total], np.uint64))
