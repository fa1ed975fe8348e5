"""Removal of repeated byte strings by a column-wise suffix order (operator 7).

Every byte goes that lies in a string of LENGTH bytes which also starts earlier: in a document of
smaller id, or earlier in the same one. Strings are judged on the input and never cross documents.

Each string of LENGTH bytes names an anchor, the ANCHOR bytes in it of the least hash (the leftmost
of equals), so equal strings have the same anchor at the same place. Strings of one anchor that start
next to each other form a piece. This only picks what is compared: pieces whose anchor occurs twice move to the
task of their anchor, equal ones as one. There the different pieces of an anchor are documents of a
collection whose Burrows-Wheeler transform is built column by column: each round inserts one symbol of every
piece and updates the transform and the common prefixes of neighbours, both read and written from front
to back in files of the shared folder. Neighbours of LENGTH common symbols begin with equal strings. As
every byte costs a pass a round, ends of pieces whose strings' hashes occur once are cut off before that.

Pieces of an anchor that occurs more than HOT times are cut by the bytes that all strings of one
stretch share; what is still more than a collection can hold is dealt out string by string, so no anchor
gathers in one task.

Null texts are empty; null ids take no part and keep their text; of rows that repeat an id, equal
starts do not count as earlier. Long texts are read in segments; what is removed of one text is gathered
where it is cut. Extra columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import TABLE, chunks, mix, prefix_sums, range_hashes
from ._runtime import materialise, prepare, replaced, scratch_path, unused, with_columns
from ._sets import bloom, in_bloom
from ._store import map_array, opened, write_array
from .kneser_ney import BLOB, Held, blob_rows, by_shard

LENGTH, ANCHOR = 100, 40
#: An anchor of more pieces is cut into stretches of so many starts; bytes of one key's pieces, or of a collection.
HOT, STRETCH, COLLECTION = 2000, 16, 1 << 20
SHARD_ANCHORS = 1 << 20
#: Symbols of the transform that are in memory at once; pieces that a task remembers.
FILE_BLOCK, SEEN = 1 << 20, 60_000
#: A longer text is read in segments of so many starts; what an anchor is depends on the string alone.
SEGMENT = 1 << 19
NONE = 0xFF  # stands before a piece in the transform; UTF-8 never has it


def segments(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts and parts of long ones, with the text and the offset of each."""
    cut = [(t[o : o + SEGMENT + LENGTH - 1], i, o) for i, t in enumerate(texts) for o in range(0, max(1, len(t)), SEGMENT)]
    parts, of, offset = zip(*cut, strict=True)
    return list(parts), np.array(of), np.array(offset)


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The pieces of the texts: text, first and last start in it, anchor's place in it, anchor's hash; and the joined bytes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64), data, begin
    sums = prefix_sums(data, TABLE)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = range_hashes(sums, at, at + ANCHOR)
    bits = len(data).bit_length()  # a hash's low bits give way to the place
    least = (grams & ~np.uint64((1 << bits) - 1)) | at.astype(np.uint64)
    width, reach = LENGTH - ANCHOR + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:n], least[width - reach : width - reach + n])
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), size + 1)[:n]
    valid = np.arange(n) + LENGTH <= begin[text] + size[text]
    change = np.ones(n, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], n) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    of, spot = text[first], anchor[first]
    return of, first - begin[of], last - begin[of], spot - begin[of], grams[spot], data, begin


class Order:
    """The transform's symbols and the common prefixes of neighbours (at most LENGTH), in a file that is read and
    written from front to back, block by block: a block's symbols, then its prefixes."""

    def __init__(self, uri: str):
        self.store, self.path = opened(uri)
        self.size = 0

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        with self.store.open_input_stream(self.path) as source:
            for at in range(0, self.size, FILE_BLOCK):
                n = min(FILE_BLOCK, self.size - at)
                both = np.frombuffer(source.read(2 * n), np.uint8)
                yield both[:n], both[n:]

    def write(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        """Another file takes this one's place when it is whole."""
        new, size = f"{self.path}.{uuid.uuid4().hex}", 0
        with self.store.open_output_stream(new) as out:
            for symbols, common in parts:
                out.write(np.concatenate([symbols, common]).data)
                size += len(symbols)
        self.store.move(new, self.path)
        self.size = size

    def delete(self) -> None:
        self.store.delete_file(self.path)


def suffix_classes(pieces: list[bytes], folder: str) -> list[np.ndarray]:
    """For each piece, the class of each start that has LENGTH bytes; equal strings have equal classes."""
    m = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, m)
    longest = int(size.max())
    columns = np.full((longest + 1, m), NONE, np.uint8)  # column j: the symbol before the suffix of length j
    for i, piece in enumerate(pieces):
        columns[: len(piece), i] = np.frombuffer(piece, np.uint8)[::-1]
    order = Order(f"{folder}/transform-{uuid.uuid4().hex}")
    order.write((columns[0, i : i + FILE_BLOCK], np.zeros(min(FILE_BLOCK, m - i), np.uint8)) for i in range(0, m, FILE_BLOCK))
    totals = np.bincount(columns[0], minlength=256)
    active, place = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        going = size[active] >= j
        active, place = active[going], place[going]
        first = m + np.concatenate([[0], np.cumsum(totals)[:-1]])
        image, common, fixes = inserted(order, place, first)
        symbols = columns[j][active]
        order.write(merged(order, image, symbols, common, *fixes))
        totals += np.bincount(symbols, minlength=256)
        place = image
    symbols, common = (np.concatenate(x) for x in zip(*order.blocks(), strict=True))
    order.delete()
    group = np.cumsum(common < LENGTH)
    back = np.argsort(symbols, kind="stable")
    back = back[: int(np.searchsorted(symbols[back], NONE))]  # the marks before whole pieces lead nowhere
    image = np.zeros(len(symbols), np.int64)
    image[back] = m + np.arange(len(back))
    out = np.full((m, max(1, longest - LENGTH + 1)), -1, np.int64)
    active, place = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        going = size[active] >= j
        active, place = active[going], image[place[going]]
        if j >= LENGTH:
            out[active, size[active] - j] = group[place]
    return [out[i, : max(0, n - LENGTH + 1)] for i, n in enumerate(size.tolist())]


def inserted(order: Order, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Where the suffixes come that begin with the symbols at the given places, what each shares with the one
    before it, and the places and common prefixes of those that a new one comes before.

    first: where the suffixes of each first symbol begin. Two that follow each other there share one symbol
    more than the least common prefix between the places of their first symbols.
    """
    by = np.argsort(place)
    asked = place[by]
    image, common = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
    fixes: list[tuple[np.ndarray, np.ndarray]] = []
    done, least = np.zeros(256, np.int64), np.full(256, 255, np.uint8)  # of each symbol: how often so far, least prefix since
    was_new, at = np.zeros(256, bool), 0
    for symbols, prefixes in order.blocks():
        low, high = np.searchsorted(asked, [at, at + len(symbols)])
        own = asked[low:high] - at
        new = np.zeros(len(symbols), bool)
        new[own] = True
        where = np.argsort(symbols, kind="stable")
        ordered = symbols[where]
        used = int(np.searchsorted(ordered, NONE))
        where, ordered = where[:used], ordered[:used]
        start = np.searchsorted(ordered, np.arange(257))
        leads = np.zeros(used, bool)  # the first of its symbol in this block
        leads[start[:-1][np.diff(start) > 0]] = True
        is_new = new[where]
        after_new = np.concatenate([[False], is_new[:-1]])[:used]
        after_new[leads] = was_new[ordered[leads]]
        ask = np.flatnonzero(is_new | after_new)
        symbol, spot = ordered[ask], where[ask]
        share = np.empty(len(ask), np.uint8)
        inside = ~leads[ask]
        share[inside] = least_between(prefixes, where[ask[inside] - 1] + 1, spot[inside] + 1)
        before = np.minimum.accumulate(prefixes)
        edge = np.flatnonzero(~inside)
        share[edge] = np.minimum(least[symbol[edge]], before[spot[edge]])
        share = np.minimum(share, LENGTH - 1) + np.uint8(1)
        share[edge[done[symbol[edge]] == 0]] = 0
        come = first[symbol] + done[symbol] + ask - start[symbol]
        mine = is_new[ask]
        which = by[low + np.searchsorted(own, spot[mine])]
        image[which], common[which] = come[mine], share[mine]
        fixes.append((come[~mine], share[~mine]))
        # what later blocks need to know
        there = np.flatnonzero(np.diff(start[:NONE + 1]) > 0)
        last = start[there + 1] - 1
        behind = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(255))
        least = np.minimum(least, before[-1])
        least[there] = behind[where[last] + 1]
        was_new[there] = is_new[last]
        done += np.bincount(symbols, minlength=256)
        at += len(symbols)
    return image, common, tuple(map(np.concatenate, zip(*fixes, strict=True)))


def least_between(numbers: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of numbers[begin:end] of each, none of them empty."""
    by = np.argsort(-begin)  # so that the gaps between ranges cost nothing
    out = np.empty(len(begin), numbers.dtype)
    if len(by):
        out[by] = np.minimum.reduceat(np.append(numbers, numbers[-1]), np.stack([begin[by], end[by]], axis=1).ravel())[::2]
    return out


def merged(order: Order, image: np.ndarray, symbols: np.ndarray, common: np.ndarray, fixed: np.ndarray, fix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of the order with the new symbols and prefixes at their places, and corrected prefixes."""
    by, by_fix, total = np.argsort(image), np.argsort(fixed), order.size + len(image)
    image, symbols, common, fixed, fix = image[by], symbols[by], common[by], fixed[by_fix], fix[by_fix]
    source = order.blocks()
    held = [np.zeros(0, np.uint8)] * 2
    for at in range(0, total, FILE_BLOCK):
        n = min(FILE_BLOCK, total - at)
        low, high = np.searchsorted(image, [at, at + n])
        while len(held[0]) < n - (high - low):
            held = [np.concatenate(x) for x in zip(held, next(source), strict=True)]
        old = np.ones(n, bool)
        old[image[low:high] - at] = False
        out = []
        for was, new in zip(held, (symbols, common), strict=True):
            block = np.empty(n, np.uint8)
            block[old], block[~old] = was[: n - (high - low)], new[low:high]
            out.append(block)
        held = [x[n - (high - low) :] for x in held]
        low, high = np.searchsorted(fixed, [at, at + n])
        out[1][fixed[low:high] - at] = fix[low:high]
        yield out[0], out[1]


#: off: how far the anchor lies behind the first start.
ROW = "key long, d long, th long, s long, n int, off int, piece binary"
#: Starts from s on, n of them, all repeated; or a string that is still to be compared.
COVERED = "d long, th long, s long, n int, string binary"


def covered(docs: DataFrame) -> DataFrame:
    """d, th, s, n: starts of repeated strings, by document (th: a hash of the text, for repeated ids)."""
    spark: SparkSession = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("th"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, size / 30 / SHARD_ANCHORS)))))
    shard_of = lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    folder = scratch_path(spark, "anchors")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at, texts in chunks(batch.column("text").cast(pa.binary()).to_pylist()):
                parts, part_of, offset = segments(texts)
                # a few segments at a time, so that a long text doesn't make long arrays
                last = 0
                for end in [*(np.flatnonzero(np.diff(np.cumsum(list(map(len, parts))) // SEGMENT)) + 1).tolist(), len(parts)]:
                    if end > last:
                        yield batch, at + part_of[last:end], offset[last:end], *runs(parts[last:end])
                    last = end

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(bits, shard_of)
        for found in each(batches):
            yield from held.add(found[7], np.ones(len(found[7]), np.uint64))
        yield from held.flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, keys, counts in blob_rows(batches, 1):
            twice = counts[:, 0] > 1
            write_array(f"{folder}/hash-{s}", keys[twice])
            write_array(f"{folder}/hot-{s}", counts[twice, 0] > HOT)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32())], names=["shard"])

    there = {r["shard"] for r in by_shard(docs.select("text").mapInArrow(count, BLOB), bits).mapInArrow(keep, "shard int").collect()}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: (map_array(f"{folder}/hash-{s}", np.uint64), map_array(f"{folder}/hot-{s}", bool)) for s in there}
        seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for batch, row, offset, of, first, last, spot, anchor, data, begin in each(batches):
            d, th = (batch.column(c).to_numpy()[row[of]] for c in ("d", "th"))
            shard = shard_of(anchor)
            twice, hot = np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
            order = np.argsort(anchor)
            cut = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
            for s in np.flatnonzero(np.diff(cut)).tolist():
                keys, is_hot = tables[s]
                own = order[cut[s] : cut[s + 1]]
                place = np.searchsorted(keys, anchor[own])
                good = place < len(keys)
                good[good] = keys[place[good]] == anchor[own][good]
                twice[own], hot[own[good]] = good, is_hot[place[good]]
            rows: list[tuple] = []
            raw = data.tobytes()

            def put(key: int, i: int, a: int, b: int) -> None:
                """The starts a to b of the text of run i, once a task for equal bytes."""
                base = int(begin[of[i]])
                piece, s = raw[base + a : base + b + LENGTH], int(offset[of[i]]) + a
                known, mine = seen.get((key, piece)), (int(d[i]), s, int(th[i]))
                if known is None:
                    seen[key, piece] = mine
                elif mine[:2] > known[:2]:
                    rows.append((key, mine[0], mine[2], s, b - a + 1, 0, None))
                    return
                elif mine[:2] < known[:2]:  # what was sent before is covered by this one where it arrives
                    seen[key, piece] = mine
                rows.append((key, mine[0], mine[2], s, b - a + 1, int(spot[i]) - a, piece))

            for i in np.flatnonzero(twice).tolist():
                a, b, p = int(first[i]), int(last[i]), int(spot[i])
                key = int(anchor[i])
                if not hot[i]:
                    put(key, i, a, b)
                    continue
                for g, low, high, core in stretches(p - a, b - a + 1, raw[int(begin[of[i]]) + a : int(begin[of[i]]) + b + LENGTH]):
                    put(_salted(key, g, core), i, a + low, a + high)
            if rows:
                columns = list(zip(*rows, strict=True))
                keys = np.array(columns[0], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c, pa.int64()) for c in columns[1:4]), *(pa.array(c, pa.int32()) for c in columns[4:6]), pa.array(columns[6], pa.binary())], names=["key", "d", "th", "s", "n", "off", "piece"])
            if len(seen) > SEEN:
                seen.clear()

    found = docs.mapInArrow(pieces, ROW)
    # rows without bytes are settled; they only pass through
    dealt = found.repartition(F.when(F.col("piece").isNull(), F.xxhash64("d", "s")).otherwise(F.col("key"))).sortWithinPartitions("key", "piece", "d", "s")
    seen = materialise(dealt.mapInArrow(lambda batches: compare(batches, folder), COVERED), "covered")
    out, rest = seen.where("string IS NULL").drop("string"), seen.where("string IS NOT NULL")
    if rest.take(1):
        rest = rest.repartition("string").sortWithinPartitions("string", "d", "s").mapInArrow(later, COVERED)
        out = out.unionByName(materialise(rest.drop("string"), "covered"))
    return out


def stretches(off: int, n: int, piece: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Number, first and last start, and shared bytes of each stretch of a piece.

    Starts fall in one stretch by their distance to the anchor; its strings all hold the shared bytes,
    so equal strings of two pieces are in stretches of one number and equal shared bytes.
    """
    for g in range((off - n + 1) // STRETCH, off // STRETCH + 1):
        low, high = off - (g + 1) * STRETCH + 1, off - g * STRETCH
        yield g, max(0, low), min(n - 1, high), piece[high : low + LENGTH]


def _salted(key: int, g: int, core: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(core, (key + g * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))


def spans_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.binary())], names=["d", "th", "s", "n", "string"])


def compare(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The repeated starts among the pieces of each key; rows come by key, piece, document and start."""
    out: list[tuple] = []
    waiting: list[tuple[bytes, tuple[int, int, int]]] = []  # different pieces of keys that have several
    ready: list[tuple[bytes, tuple[int, int, int]]] = []  # what is left of them
    group: list[tuple[bytes, tuple[int, int, int]]] = []
    key, size, waits, readies, last = None, 0, 0, 0, (None, None)

    def settle(end: bool) -> None:
        """Cut waiting pieces; build a collection of what is ready."""
        nonlocal waiting, ready, waits, readies
        if waits > COLLECTION or (end and waiting):
            some = shortened(waiting, out)
            ready += some
            readies += sum(len(p) for p, _ in some)
            waiting, waits = [], 0
        if readies > COLLECTION or (end and ready):
            out.extend(_compared(ready, folder))
            ready, readies = [], 0

    def strings(piece: bytes, at: tuple[int, int, int]) -> None:
        out.extend((at[0], at[2], at[1] + i, 1, piece[i : i + LENGTH]) for i in range(len(piece) - LENGTH + 1))

    for batch in batches:
        for k, d, th, s, n, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "d", "th", "s", "n", "piece")), strict=True):
            if piece is None:
                out.append((d, th, s, n, None))
                continue
            if k != key:
                if len(group) > 1:
                    waiting += group
                    waits += size
                key, group, size, last = k, [], 0, (None, None)
                settle(False)
            if piece == last[0]:
                if (d, s) > last[1][:2]:
                    out.append((d, th, s, n, None))
                continue
            last = (piece, (d, s, th))
            size += len(piece)
            if size <= COLLECTION:
                group.append(last)
                continue
            for x in (*group, last):  # too many for one collection
                strings(*x)
            group = []
            if len(out) > 1 << 16:
                yield spans_of(out)
                out.clear()
        if len(out) > 1 << 16:
            yield spans_of(out)
            out.clear()
    if len(group) > 1:
        waiting += group
    settle(True)
    if out:
        yield spans_of(out)


def shortened(pieces: list[tuple[bytes, tuple[int, int, int]]], out: list[tuple]) -> list[tuple[bytes, tuple[int, int, int]]]:
    """The stretches of pieces whose strings' hashes occur more than once. Stretches that become equal are one, that of
    the earliest start; the others' starts go to out."""
    for _ in range(2):
        if not pieces:
            break
        size = np.fromiter((len(p) for p, _ in pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        starts = size - LENGTH + 1
        of = np.repeat(np.arange(len(pieces)), starts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
        spot = begin[of] + at
        hashes = range_hashes(prefix_sums(np.frombuffer(b"".join(p for p, _ in pieces), np.uint8), TABLE), spot, spot + LENGTH)
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = times[which] > 1
        edge = np.ones(len(of), bool)
        edge[1:] = (again[1:] != again[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(of)) - 1
        some = again[first]
        known: dict[bytes, tuple[int, int, int]] = {}
        for i, a, b in zip(of[first[some]].tolist(), at[first[some]].tolist(), at[last[some]].tolist(), strict=True):
            piece, (d, s, th) = pieces[i]
            cut, mine = piece[a : b + LENGTH], (d, s + a, th)
            other = known.get(cut)
            if other is None or mine[:2] < other[:2]:
                known[cut], mine = mine, other
            if mine is not None and mine[:2] != known[cut][:2]:
                out.append((mine[0], mine[2], mine[1], b - a + 1, None))
        pieces = list(known.items())
    return pieces


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by string, document and start, all but the first start of each string."""
    string, first = None, (0, 0)
    for batch in batches:
        out = []
        for d, th, s, own in zip(*(batch.column(c).to_pylist() for c in ("d", "th", "s", "string")), strict=True):
            if own != string:
                string, first = own, (d, s)
            elif (d, s) > first:
                out.append((d, th, s, 1, None))
        if out:
            yield spans_of(out)


def _compared(pieces: list[tuple[bytes, tuple[int, int, int]]], folder: str) -> list[tuple]:
    """The starts of pieces whose strings start earlier in another."""
    d, s, th = np.array([x for _, x in pieces], np.int64).T
    classes = suffix_classes([p for p, _ in pieces], folder)
    size = np.fromiter(map(len, classes), np.int64, len(classes))
    of = np.repeat(np.arange(len(classes)), size)
    start = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    what, doc, at = np.concatenate(classes), d[of], s[of] + start
    order = np.lexsort((at, doc, what))
    new = np.ones(len(order), bool)
    new[1:] = what[order][1:] != what[order][:-1]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    late = np.zeros(len(order), bool)
    late[order] = (doc[order] > doc[lead]) | ((doc[order] == doc[lead]) & (at[order] > at[lead]))
    edge = np.diff(late.astype(np.int8), prepend=0)
    edge[np.cumsum(size)[:-1]] = np.where(late[np.cumsum(size)[:-1]], 1, 0)  # a piece's stretch doesn't go on in the next
    begin = np.flatnonzero(edge == 1)
    end = np.array([i for i in np.flatnonzero(late) if i + 1 == len(late) or not late[i + 1] or of[i + 1] != of[i]], np.int64)
    return [(*x, None) for x in zip(doc[begin].tolist(), th[of[begin]].tolist(), at[begin].tolist(), (end - begin + 1).tolist(), strict=True)]


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the bytes left)."""
    prepare(docs.sparkSession)
    new = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())]
    docs = docs.drop(*(n for n, _ in new))
    found = covered(docs)
    ids = materialise(found.select("d").distinct(), "ids")
    touched = docs.sparkSession.sparkContext.broadcast(bloom(ids, ids.count()))  # at most BLOOM_BITS
    own_id, d, th, covering = unused(docs, "id", "d", "th", "spans")
    keyed = docs.withColumn(own_id, F.col("doc_id").cast("long"))

    def some(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bloom(touched.value, batch.column(own_id)) == wanted))

        return keyed.mapInArrow(run, keyed.schema)

    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    whole = some(False).drop(own_id).withColumns({"n_bytes": F.length(body).cast("long"), "n_removed": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long"), "kept": body})
    spans = found.groupBy(F.col("d").alias(d), F.col("th").alias(th)).agg(F.collect_list(F.struct("s", "n")).alias(covering))
    joined = some(True).join(spans, (F.col(own_id) == F.col(d)) & (F.xxhash64("text") == F.col(th)), "left").drop(d, th, own_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column(covering).to_pylist(), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                depth = np.zeros(len(data) + 1, np.int64)
                for x in own or ():
                    depth[x["s"]] += 1
                    depth[x["s"] + x["n"] - 1 + LENGTH] -= 1
                gone = np.cumsum(depth[:-1]) > 0
                rows.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), data[~gone].tobytes()))
            n, removed, runs_, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
            rest = batch.drop_columns([covering])
            yield replaced(rest, {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs_, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return whole.unionByName(joined.mapInArrow(cut, with_columns(docs.schema, new)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
