"""Exact joins of sets by Jaccard similarity, shared by the n-gram join and the line dedup.

A record is a text (or a line) as the set of its word shingles, each a 64-bit hash. Equal sets form
a class, known by two 64-bit sums over its tokens (k1, k2); classes, not records, are joined. Tokens
stand in one global order: by how often their slot of a count table over the whole corpus was hit,
then by hash. Two sets of the asked similarity share a token among their first (prefix) tokens, at
places that leave enough tokens behind it. Where Rule.double is set, a frequent prefix token of a set of
at most so many tokens stands only together with a second token behind it: two such sets share their
first two common tokens, and groups stay small however often single words occur. The table has
Rule.slots counters, whatever the corpus; a coarser table only makes the order less good, never the
join less exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import Words, chunks, mix
from ._runtime import materialise, prepare, release, trim

SLICES = 64
#: The largest group of records compared in one task.
BLOCK = 2048
#: Rows that a task gathers before it compares groups, and tokens of the sets of one block of a cluster.
GATHER, BLOCK_TOKENS = 1 << 16, 1 << 20
#: Rank (eight times the logarithm of the hits) of a frequent token (512 times).
OFTEN = 72


@dataclass(frozen=True)
class Rule:
    """Jaccard similarity of at least a / b over shingles of k words, of whole texts or of lines.

    words: 64-bit words of the parity bitmaps.
    """

    k: int
    a: int
    b: int
    lines: bool
    slots: int = 1 << 22
    words: int = 4
    double: int = 0

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.a * n + self.b - 1) // self.b + 1

    def overlap(self, total):
        """Common tokens that two sets of total tokens together need."""
        return -((-self.a * total) // (self.a + self.b))


@dataclass
class Records:
    """Records of a run of texts: text index, line number, set size, class sums, the ordered tokens and their ranks."""

    text: np.ndarray
    line: np.ndarray
    n: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    tokens: np.ndarray
    rank: np.ndarray
    start: np.ndarray


def occurrences(words: Words, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and line of each record; then each token occurrence and the record it is of."""
    if rule.lines:
        begin = np.concatenate([[0], np.flatnonzero(words.data == 10) + 1])[:-1]
        text = np.searchsorted(words.text_start, begin, side="right") - 1
        line = np.arange(len(begin)) - np.searchsorted(begin, words.text_start[text])
        first = np.append(np.searchsorted(words.start, begin), len(words.start))
    else:
        text, first = np.arange(len(words.first) - 1), words.first
        line = np.zeros(len(text), np.int64)
    size = np.diff(first)
    of = np.repeat(np.arange(len(size)), size)
    tokens = words.shingles(rule.k)
    inside = of[: len(tokens)] == of[rule.k - 1 :] if len(tokens) else np.zeros(0, bool)
    tokens, of = tokens[inside], of[: len(inside)][inside]
    few = np.flatnonzero((size > 0) & (size < rule.k))
    if len(few):
        tokens = np.concatenate([tokens, *(words.whole(first[i], first[i + 1]) for i in few)])
        of = np.concatenate([of, few])
    return text, line, tokens, of


def records(words: Words, rule: Rule, rarity: np.ndarray) -> Records:
    """The records with at least one word; rarity: the table's bytes."""
    text, line, tokens, of = occurrences(words, rule)
    rank, mixed = rarity[tokens & np.uint64(rule.slots - 1)], mix(tokens)
    order = sorted_tokens(of, rank, mixed, len(text))
    tokens, mixed, of, rank = tokens[order], mixed[order], of[order], rank[order]
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (of[1:] != of[:-1])
    tokens, mixed, of, rank = tokens[keep], mixed[keep], of[keep], rank[keep]
    start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rec = of[start]
    sums = [np.add.reduceat(x, start) if len(start) else np.zeros(0, np.uint64) for x in (mixed, mix(mixed ^ np.uint64(0x5851F42D4C957F2D)))]
    return Records(text[rec], line[rec], np.diff(np.append(start, len(tokens))), sums[0].view(np.int64), sums[1].view(np.int64), tokens, rank, start)


def sorted_tokens(of: np.ndarray, rank: np.ndarray, mixed: np.ndarray, n: int) -> np.ndarray:
    """The order of tokens by record (of n), rank and hash: one sort of numbers that hold these, as far as
    the bits go, and the place; runs that they can't tell apart are sorted again."""
    record_bits, place_bits = max(1, (n - 1).bit_length()), max(1, (len(of) - 1).bit_length())
    hash_bits = 64 - 8 - record_bits - place_bits
    if hash_bits < 8:
        return np.lexsort((mixed, rank, of))
    front = (of.astype(np.uint64) << np.uint64(64 - record_bits)) | (rank.astype(np.uint64) << np.uint64(56 - record_bits))
    packed_keys = np.sort(front | (mixed >> np.uint64(64 - hash_bits) << np.uint64(place_bits)) | np.arange(len(of), dtype=np.uint64))
    order = (packed_keys & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    packed_keys >>= np.uint64(place_bits)
    found = mixed[order]
    same = packed_keys[1:] == packed_keys[:-1]
    unclear = same & (found[1:] != found[:-1])
    if unclear.any():
        run = np.concatenate([[0], np.cumsum(~same)])
        at = np.flatnonzero(np.isin(run, run[1:][unclear]))
        order[at] = order[at][np.lexsort((found[at], run[at]))]
    return order


def only(rec: Records, which: Callable[[Records], np.ndarray]) -> Records:
    """The chosen records."""
    some = which(rec)
    count = rec.n[some]
    at = spans(rec.start[some], count)
    return Records(rec.text[some], rec.line[some], count, rec.k1[some], rec.k2[some], rec.tokens[at], rec.rank[at], np.cumsum(count) - count)


def keys(rec: Records, rule: Rule, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the chosen records stand under in the index: the record, the key, and its token's place.

    Sets a little smaller than rule.double stand under frequent tokens both alone and in twos, as they may
    match larger ones.
    """
    count = np.where(which, rule.prefix(rec.n), 0)
    own, at = np.repeat(np.arange(len(count)), count), spans(rec.start, count)
    place, token, rank, n = at - rec.start[own], rec.tokens[at], rec.rank[at], rec.n[own]
    two = (rank >= OFTEN) & (n > 1) & (n <= rule.double)
    one = ~two | (n * rule.b > rule.double * rule.a)
    i = np.flatnonzero(two)
    behind = np.minimum(count[own[i]], n[i] - 1) - place[i]
    i, second = np.repeat(i, behind), spans(at[i] + 1, behind)
    both = mix(token[i] * np.uint64(0xD1342543DE82EF95) + rec.tokens[second])
    return np.concatenate([own[one], own[i]]), np.concatenate([token[one], both]), np.concatenate([place[one], place[i]])


def bitmaps(rec: Records, rule: Rule) -> np.ndarray:
    """Parity bitmaps, rule.words words of each record: two sets differ in at least as many tokens as bits."""
    bits = rule.words * 64
    own = np.repeat(np.arange(len(rec.n)), rec.n)
    parity = np.bincount(own * bits + ((rec.tokens >> np.uint64(24)) & np.uint64(bits - 1)).astype(np.int64), minlength=len(rec.n) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64).reshape(-1, rule.words)


def each_run(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, int, Words]]:
    for batch in batches:
        for first, run in chunks(batch.column(text).cast(pa.binary()).to_pylist()):
            yield batch, first, Words(run)
    trim()


def reduce_slices(parts: DataFrame, how: Callable[[np.ndarray, np.ndarray], np.ndarray], last: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[int, bytes]:
    """Fold the (slice, packed 32-bit numbers) rows of all tasks, last of all by last; the result has a fixed size."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, size, blob in zip(*(batch.column(c).to_pylist() for c in ("slice", "size", "blob")), strict=True):
                part = np.frombuffer(pa.decompress(blob, size, "zstd"), np.uint32)
                held[s] = how(held[s], part) if s in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([last(v).tobytes() for v in held.values()], pa.binary())], names=["slice", "blob"])

    found = parts.repartition("slice").mapInArrow(fold, "slice int, blob binary")
    return {r["slice"]: bytes(r["blob"]) for r in found.collect()}


def packed(numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for reduce_slices of a whole table cut into SLICES, a few at a time."""
    cut = numbers.reshape(SLICES, -1)
    for s in np.flatnonzero(cut.any(axis=1)).tolist():
        blob = pa.compress(cut[s].astype(np.uint32).tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([cut.shape[1] * 4], pa.int64()), pa.array([blob], pa.binary())], names=["slice", "size", "blob"])


PACKED = "slice int, size long, blob binary"


def rarity_table(docs: DataFrame, rule: Rule) -> np.ndarray:
    """rule.slots bytes: eight times the logarithm of each slot's hits over all texts."""
    slots = rule.slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(slots, np.uint16)  # a task's hits beyond 65535 don't change the order by much
        for _, _, words in each_run(batches):
            slot, n = np.unique(occurrences(words, rule)[2] & np.uint64(slots - 1), return_counts=True)
            slot = slot.astype(np.int64)
            hits[slot] = np.minimum(hits[slot] + n, 0xFFFF)
        yield from packed(hits)

    add = lambda x, y: np.minimum(x.astype(np.uint64) + y, 0xFFFFFFFF).astype(np.uint32)
    scaled = lambda x: np.minimum(255, np.rint(np.log2(x + 1.0) * 8)).astype(np.uint8)
    table = np.zeros((SLICES, slots // SLICES), np.uint8)
    for s, part in reduce_slices(docs.select("text").mapInArrow(count, PACKED), add, scaled).items():
        table[s] = np.frombuffer(part, np.uint8)
    return table.ravel()


#: A filter has 16 bits an id up to this size, 16 MB.
BLOOM_BITS = 1 << 27


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])


def bloom(ids: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of a column of about count longs; it only spares work, and joins decide."""
    bits = min(BLOOM_BITS, 1 << max(16, (16 * count).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            places = _bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            np.bitwise_or.at(found, places >> np.uint64(5), np.uint32(1) << (places & np.uint64(31)).astype(np.uint32))
        yield from packed(found)

    table = np.zeros((SLICES, bits // 32 // SLICES), np.uint32)
    for s, part in reduce_slices(ids.mapInArrow(mark, PACKED), np.bitwise_or).items():
        table[s] = np.frombuffer(part, np.uint32)
    return table.ravel()


def marked(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    places = _bloom_places(ids, len(table) * 32)
    return ((table[places >> np.uint64(5)] >> (places & np.uint64(31)).astype(np.uint32)) & 1).all(axis=0)


def in_bloom(table: np.ndarray, ids: pa.Array) -> np.ndarray:
    return marked(table, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start[i] to start[i] + count[i] of all i, one after the other."""
    total = int(count.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


#: Records that a task gathers before it passes them on, each class with the index keys of its first record only.
WINDOW = 1 << 16
SCAN = "d long, th long, l int, k1 long, k2 long, n long, bitmap array<long>, keys array<long>, places array<int>"


def scan(docs: DataFrame, rule: Rule, rarity) -> DataFrame:
    """d, th (a hash of the text, for repeated ids), l, k1, k2, n of every record; once a window and class,
    with its first record there, the parity bitmap and the index keys."""

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        d, th, line, k1, k2, n = (pa.concat_arrays([p[i] for p in parts]) for i in range(6))
        keyed = [np.concatenate([p[i] for p in parts]) for i in range(6, 9)]  # keys a record, keys, places
        words = np.concatenate([p[9] for p in parts])
        k = [x.to_numpy() for x in (k1, k2)]
        order = np.lexsort((line.to_numpy(), d.fill_null(np.iinfo(np.int64).max).to_numpy(), k[1], k[0]))
        first = np.ones(len(order), bool)
        first[order[1:]] = (k[0][order[1:]] != k[0][order[:-1]]) | (k[1][order[1:]] != k[1][order[:-1]])
        first &= d.is_valid().to_numpy(zero_copy_only=False) & (n.to_numpy() > 0)
        count = np.where(first, keyed[0], 0)
        some = spans(np.cumsum(keyed[0]) - keyed[0], count)
        bitmap = lists(words[first].ravel(), np.where(first, rule.words, 0))
        return pa.RecordBatch.from_arrays([d, th, line, k1, k2, n, bitmap, lists(keyed[1][some], count), lists(keyed[2][some], count)], names=["d", "th", "l", "k1", "k2", "n", "bitmap", "keys", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held = 0
        for batch, at, words in each_run(batches):
            rec = records(words, rule, rarity.value)
            own, key, place = keys(rec, rule, np.ones(len(rec.n), bool))
            order = np.argsort(own, kind="stable")
            count = np.bincount(own, minlength=len(rec.n))
            text, zero = rec.text, np.zeros(0, np.int64)
            if not rule.lines:  # texts without words are records of no tokens
                zero = np.setdiff1d(np.arange(len(words.first) - 1), rec.text)
                text = np.concatenate([text, zero])
            none = np.zeros(len(zero), np.int64)
            rows = pa.array(text + at)
            numbers = [np.concatenate([x, none]) for x in (rec.line, rec.k1, rec.k2, rec.n, count)]
            parts.append((batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(numbers[0].astype(np.int32)), *map(pa.array, numbers[1:4]), numbers[4], key[order].view(np.int64), place[order].astype(np.int32), np.concatenate([bitmaps(rec, rule), np.zeros((len(zero), rule.words), np.int64)])))
            held += len(text) + len(key) // 8
            if held > WINDOW:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, SCAN)


def entries(found: DataFrame) -> DataFrame:
    """tok, place, r (k1), n: a row for each index key."""
    rows = found.where(F.size("keys") > 0).select(F.col("k1").alias("r"), "n", F.arrays_zip("keys", "places").alias("e"))
    return rows.select("r", "n", F.inline("e")).withColumnsRenamed({"keys": "tok", "places": "place"})


def gathered(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """Tables of about so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= (rows or GATHER):
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], rows: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that are equal in the named columns; the rows come in their order."""
    rest: pa.Table | None = None
    for table in gathered(batches, rows):
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        own = np.stack([table[c].to_numpy() for c in names])
        change = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(axis=0))
        cut = int(change[-1]) + 1 if len(change) else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def shared(found: DataFrame, rule: Rule) -> DataFrame:
    """tok, r, n, place, lead: an index entry for each key that at least two classes have, with the least class
    of the key where the sizes allow a link with it (else r itself). A task holds no group, however large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = lead = alone = None  # tok and r of the row before; r and n of its group's first; that row while it is the only one
        for table in gathered(batches):
            tok, r, n, place = (table[c].to_numpy() for c in ("tok", "r", "n", "place"))
            begins = np.concatenate([[last is None or tok[0] != last[0]], tok[1:] != tok[:-1]])
            again = np.concatenate([[not begins[0] and r[0] == last[1]], (r[1:] == r[:-1]) & ~begins[1:]])
            last = (tok[-1], r[-1])
            tok, r, n, place, begins = (x[~again] for x in (tok, r, n, place, begins))
            if not len(tok):
                continue
            if alone is not None:
                if not begins[0]:
                    tok, r, n, place = (np.concatenate([[x], y]) for x, y in zip(alone, (tok, r, n, place), strict=True))
                    begins = np.concatenate([[True], begins])
                alone = None
            first = np.maximum.accumulate(np.where(begins, np.arange(len(tok)), -1))
            old = first < 0
            lead_r, lead_n = np.where(old, lead[0] if lead else 0, r[first]), np.where(old, lead[1] if lead else 0, n[first])
            start = np.flatnonzero(begins)
            keep = np.ones(len(tok), bool)
            if len(start):
                size = np.diff(np.append(start, len(tok)))
                keep[start[size == 1]] = False
                lead = (r[start[-1]], n[start[-1]])
                if size[-1] == 1:
                    alone = (tok[-1], r[-1], n[-1], place[-1])
            fits = rule.b * np.minimum(n, lead_n) >= rule.a * np.maximum(n, lead_n)
            out = [tok, r, n, place.astype(np.int32), np.where(fits, lead_r, r)]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], names=["tok", "r", "n", "place", "lead"])

    rows = entries(found).select("tok", "r", "n", "place").repartition("tok").sortWithinPartitions("tok", "r")
    return rows.mapInArrow(run, "tok long, r long, n long, place int, lead long")


def clusters(index: DataFrame) -> DataFrame:
    """r, g: classes that are likely linked get one g; pairs within a g are compared there, all others by pairs().

    A class follows the least class that most of its keys name, and that one's, for a few steps.
    """
    hits = index.where("lead <> r").groupBy("r", "lead").agg(F.count(F.lit(1)).alias("hits"))
    up = hits.groupBy("r").agg(F.max_by("lead", F.struct("hits", -F.col("lead"))).alias("g"))
    for _ in range(2):
        up = up.join(up.select(F.col("r").alias("g"), F.col("g").alias("over")), "g", "left").select("r", F.coalesce("over", "g").alias("g"))
    up = materialise(up, "up")
    return up.union(up.select(F.col("g").alias("r"), "g").distinct().join(up.select("r"), "r", "left_anti"))


#: Of at most so many rows a table of ids is broadcast; a larger one is joined by shuffle.
SMALL = 200_000


def sized(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= SMALL else df


#: Rows and list elements of a table of lists that is broadcast at most.
SMALL_LISTS = 2_000_000


def candidate_sets(docs: DataFrame, rule: Rule, rarity, wanted: DataFrame, orders: int = 0) -> DataFrame:
    """For the classes in wanted (d, l, k1, k2 and more, which is kept): the set's tokens by rarity, and its
    prefixes under further token orders (32-bit hashes, which may only let more pairs through)."""
    sc = docs.sparkSession.sparkContext
    n = wanted.count()
    texts, classes = (sc.broadcast(bloom(wanted.select(c), n)) for c in ("d", "k1"))  # at most BLOOM_BITS each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (batch.filter(pa.array(in_bloom(texts.value, batch.column("doc_id")))) for batch in batches)
        for batch, at, words in each_run(b for b in kept if b.num_rows):
            rec = only(records(words, rule, rarity.value), lambda r: marked(classes.value, r.k1))
            if not len(rec.n):
                continue
            arrays = [batch.column("doc_id").take(pa.array(rec.text + at)), pa.array(rec.line.astype(np.int32)), pa.array(rec.k1), pa.array(rec.k2), lists(rec.tokens.view(np.int64), rec.n)]
            for i in range(orders):
                count = rule.prefix(rec.n)
                h = by_order(rec.tokens, np.repeat(np.arange(len(rec.n)), rec.n), i)[0]
                arrays.append(lists((h[spans(rec.start, count)] >> np.uint64(32)).astype(np.uint32).view(np.int32), count))
            yield pa.RecordBatch.from_arrays(arrays, names=["d", "l", "k1", "k2", "tokens", *(f"order{i}" for i in range(orders))])

    schema = "d long, l int, k1 long, k2 long, tokens array<long>" + "".join(f", order{i} array<int>" for i in range(orders))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return found.join(sized(wanted, n), ["d", "l", "k1", "k2"])


def by_order(tokens: np.ndarray, own: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' places in hash order i, ascending in each set; and which token each is of."""
    h = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D * (i + 1)))
    by = np.argsort(h)
    by = by[np.argsort(own[by].astype(np.uint16 if len(own) and own[-1] < 65535 else np.int64), kind="stable")]
    return h[by], by


def compared(last: np.ndarray, n: np.ndarray, place: np.ndarray, bitmap: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """x, y, and in how many bits they differ: the pairs of each group (up to last) that pass the length, place
    and bitmap filters. Sizes ascend in a group, and the smaller set of a pair has the token near its begin."""
    left, shift = np.flatnonzero(n - place >= rule.overlap(2 * n)), 0
    while True:
        shift += 1
        left = left[left + shift < last[left]]
        left = left[rule.b * n[left] >= rule.a * n[left + shift]]  # what is too large stays so
        if not len(left):
            return
        x, y = left, left + shift
        total = n[x] + n[y]
        need = rule.overlap(total)
        fit = np.minimum(n[x] - place[x], n[y] - place[y]) >= need
        x, y, most = x[fit], y[fit], (total - 2 * need)[fit]
        apart = np.bitwise_count(bitmap[x] ^ bitmap[y]).sum(axis=1, dtype=np.int64)
        fit = apart <= most
        if fit.any():
            yield x[fit], y[fit], apart[fit]


def group_ends(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's group of equal rows begins, and where it ends."""
    change = np.ones(len(columns[0]), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(change)
    size = np.diff(np.append(begin, len(change)))
    return np.repeat(begin, size), np.repeat(begin + size, size)


#: Index entries of one shard on average, and those at which a task looks for groups to cut.
SHARD, SHARD_MOST = 250_000, 2_000_000
#: Nearest earlier classes that are kept of each key, and the largest group in which they are looked for.
KEPT, NEAR = 4, 512
#: Of a key, bits that come first in an entry's sort key; the size takes what is left beside 8 bits of the class.
TOK_BITS, MOST_N = 43, (1 << 13) - 1


def packed_entries(found: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """shard, n, blob: the index entries of each task, by the key's first bits, column by column and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            count = pc.list_value_length(table["keys"]).to_numpy()
            flat = lambda c: pc.list_flatten(table[c]).to_numpy()  # noqa: B023, E731
            tok, place, words = flat("keys"), flat("places"), flat("bitmap").reshape(-1, rule.words)
            own = np.repeat(np.arange(len(count)), count)
            shard = (tok.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tok), np.int64)
            order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
            columns = [tok, *(table[c].to_numpy()[own] for c in ("k1", "n")), place, *(table[c].to_numpy()[own] for c in ("d", "l")), *(words[own, i] for i in range(rule.words))]
            columns = [c[order].astype(np.int64) for c in columns]
            cut = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut))
            blobs = [planes([c[cut[i] : cut[i + 1]] for c in columns]) for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(cut)[some]), pa.array(blobs, pa.binary())], names=["shard", "n", "blob"])

    rows = found.where(F.size("keys") > 0).select("d", "l", "k1", "n", "bitmap", "keys", "places")
    rows = rows.mapInArrow(run, "shard int, n long, blob binary")
    return rows.repartition(min(1 << bits, 1 << 15), "shard").sortWithinPartitions("shard")


def planes(columns: list[np.ndarray]) -> bytes:
    """Numbers column by column, first bytes first."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def numbers(blob: bytes, n: int, columns: int) -> list[np.ndarray]:
    found = np.frombuffer(pa.decompress(blob, n * columns * 8, "zstd"), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in found]


def nearest_earlier(found: DataFrame, rule: Rule) -> DataFrame:
    """Candidates and groups that hold more of them.

    r1, r2, apart: for each key of a class, the KEPT earlier classes of the nearest bitmaps. Where a class of a
    key has more earlier ones, or a group is beyond NEAR and was cut, r2 is null and there is a row for each entry of the
    key: tok, r1, n, place, d, l, bitmap, and whether this class has more.
    """
    size = found.agg(F.coalesce(F.sum(F.when(F.size("keys") > 0, F.col("n") * (rule.b - rule.a) / rule.b + 1)), F.lit(0.0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, size / SHARD)))))
    width = 6 + rule.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held, cut = None, [], 0, np.zeros(0, np.int64)
        for batch in batches:
            for s, n, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "blob")), strict=True):
                if s != shard:
                    if parts:
                        yield nearest(once(parts), cut)
                    shard, parts, held, cut = s, [], 0, np.zeros(0, np.int64)
                parts.append(numbers(blob, n, width))
                held += n
                if held > SHARD_MOST:
                    rows = once(parts)
                    begin, end = group_ends(rows[0])
                    large = (end - begin > NEAR) | np.isin(rows[0], cut)
                    if large.any():
                        some = [c[large] for c in rows]
                        cut = np.union1d(cut, some[0])
                        yield nearest(some, cut)
                    parts = [[c[~large] for c in rows]]
                    held = len(parts[0][0])
        if parts:
            yield nearest(once(parts), cut)
        trim()

    def once(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """All entries by key and size; a class comes once from each window that met it, and its earliest line counts."""
        rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
        tok, r, n = (x.view(np.uint64) for x in rows[:3])
        # one sort by the first bits of the key, the size, and some of the class; by all of each where that doesn't do
        near = (tok >> np.uint64(64 - TOK_BITS) << np.uint64(64 - TOK_BITS)) | (np.minimum(n, np.uint64(MOST_N)) << np.uint64(8)) | (r & np.uint64(255))
        order = np.argsort(near)
        found = tok[order]
        mixed = (found[1:] != found[:-1]) & (found[1:] >> np.uint64(64 - TOK_BITS) == found[:-1] >> np.uint64(64 - TOK_BITS))
        if mixed.any() or (len(n) and n.max() > MOST_N):
            order = np.lexsort((rows[1], rows[2], rows[0]))
        rows = [c[order] for c in rows]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([rows[i][1:] != rows[i][:-1] for i in (0, 1, 2)])
        if not new.all():
            group = np.cumsum(new) - 1
            order = np.lexsort((rows[5], rows[4], group))
            rows = [c[order][new] for c in rows]  # groups keep their places
        return rows

    def nearest(rows: list[np.ndarray], cut: np.ndarray) -> pa.RecordBatch:
        tok, r, n, place, d, line = rows[:6]
        bitmap = np.stack(rows[6:], axis=1).view(np.uint64)
        begin, end = group_ends(tok)
        large = (end - begin > NEAR) | np.isin(tok, cut)
        end = np.minimum(end, begin + ((np.arange(len(tok)) - begin) // NEAR + 1) * NEAR)
        best, partner, seen = np.full((KEPT, len(tok)), 1 << 30), np.full((KEPT, len(tok)), -1), np.zeros(len(tok), np.int64)
        for x, y, apart in compared(end, n, place, bitmap, rule):
            later = (d[x] > d[y]) | ((d[x] == d[y]) & (line[x] > line[y]))
            earlier = (d[x] < d[y]) | ((d[x] == d[y]) & (line[x] < line[y]))
            for one, two, some in ((x, y, later), (y, x, earlier)):
                i, j, a = one[some], two[some], apart[some]
                seen[i] += 1
                for k in range(KEPT):  # each goes in where it is nearer; the farther one goes on to the next place
                    old, old_j = best[k, i], partner[k, i]
                    nearer = a < old
                    best[k, i], partner[k, i] = np.where(nearer, a, old), np.where(nearer, j, old_j)
                    a, j = np.where(nearer, old, a), np.where(nearer, old_j, j)
        hits = [np.flatnonzero(partner[k] >= 0) for k in range(KEPT)]
        one, two = (np.concatenate([x[h] for x, h in zip(c, hits, strict=True)]) for c in ([r] * KEPT, [r[p] for p in partner]))
        more = large | (seen > KEPT)
        whole = np.flatnonzero(np.repeat(np.logical_or.reduceat(more, np.unique(begin)), np.diff(np.append(np.unique(begin), len(tok))))) if len(tok) else np.zeros(0, np.int64)
        empty = lambda kind, n: pa.nulls(n, kind)
        some, rest = len(one), len(whole)
        both = lambda first, second, kind: pa.concat_arrays([pa.array(first, kind) if first is not None else empty(kind, some), pa.array(second, kind) if second is not None else empty(kind, rest)])
        near = np.concatenate([best[k, h] for k, h in enumerate(hits)])
        words = pa.concat_arrays([empty(pa.list_(pa.int64()), some), lists(bitmap[whole].view(np.int64).ravel(), np.full(rest, rule.words))])
        columns = [both(one, r[whole], pa.int64()), both(two, None, pa.int64()), both(near.astype(np.int32), None, pa.int32()), both(None, more[whole], pa.bool_()), *(both(None, c[whole], pa.int64()) for c in (tok, n)), *(both(None, c[whole].astype(np.int32), pa.int32()) for c in (place, line)), both(None, d[whole], pa.int64()), words]
        return pa.RecordBatch.from_arrays(columns, names=["r1", "r2", "apart", "more", "tok", "n", "place", "l", "d", "bitmap"])

    return packed_entries(found, rule, bits).mapInArrow(run, "r1 long, r2 long, apart int, more boolean, tok long, n long, place int, l int, d long, bitmap array<long>")


def pairs(rows: DataFrame, rule: Rule, ordered: bool) -> DataFrame:
    """r1, r2: pairs of classes that share a token and pass the length, place and bitmap filters.

    rows: tok, r, n, place, df, bitmap, g, and where ordered d, l, open. Rows of equal g are not paired; d and
    l rank the classes, the later must be open, and comes first in the pair. A token of many rows is cut into
    blocks, and each pair of blocks is compared in a task of its own.
    """
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("r"), blocks).cast("int")
    small = rows.where(F.col("df") <= BLOCK).withColumns({"b": F.lit(0), "b1": F.lit(0), "b2": F.lit(0)})
    large = rows.where(F.col("df") > BLOCK).withColumn("b", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    large = large.withColumns({"b1": F.least("b", "other"), "b2": F.greatest("b", "other")}).drop("other")
    dealt = small.unionByName(large).drop("df").repartition("tok", "b1", "b2").sortWithinPartitions("tok", "b1", "b2", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("tok", "b1", "b2")):
            tok, r, n, place, g, b, b1, b2 = (table[c].to_numpy() for c in ("tok", "r", "n", "place", "g", "b", "b1", "b2"))
            d, line, is_open = (table[c].to_numpy() for c in ("d", "l", "open")) if ordered else (None, None, None)
            bitmap = pc.list_flatten(table["bitmap"]).to_numpy().view(np.uint64).reshape(-1, rule.words)
            found: list[np.ndarray] = []
            for x, y, _ in compared(group_ends(tok, b1, b2)[1], n, place, bitmap, rule):
                fit = (g[x] != g[y]) & ((b1[x] == b2[x]) | (b[x] != b[y]))
                if ordered:
                    later = (d[x] > d[y]) | ((d[x] == d[y]) & (line[x] > line[y]))
                    fit &= np.where(later, is_open[x], is_open[y]) & ((d[x] != d[y]) | (line[x] != line[y]))
                else:
                    later = r[x] > r[y]
                found.append(np.stack([np.where(later, r[x], r[y])[fit], np.where(later, r[y], r[x])[fit]]))
                if sum(f.shape[1] for f in found) > 1 << 18:
                    yield made(found)
                    found = []
            if found:
                yield made(found)
        trim()

    def made(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1)
        both = both[:, np.lexsort(both)]
        keep = np.ones(both.shape[1], bool)
        keep[1:] = (both[:, 1:] != both[:, :-1]).any(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both[:, keep]], names=["r1", "r2"])

    return dealt.mapInArrow(run, "r1 long, r2 long").distinct()


def key(a: str = "k1", b: str = "k2"):
    """A class as one column."""
    return F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))


def verified(found: DataFrame, sets: DataFrame, rule: Rule, orders: int = 0) -> DataFrame:
    """v, w: the classes of the pairs (r1, r2) that share a prefix token under each further order and whose sets
    reach the similarity. Whole sets are moved only for pairs that pass the orders."""
    for i in (1, 2):
        found = found.join(sets.select(F.col("k1").alias(f"r{i}"), key().alias("vw"[i - 1]), *(F.col(f"order{j}").alias(f"order{j}_{i}") for j in range(orders))), f"r{i}") if orders else found
    for j in range(orders):
        found = found.where(F.arrays_overlap(f"order{j}_1", f"order{j}_2"))
    if orders:
        found = found.select("v", "w")
    for i in (1, 2):
        own = sets.select(*([key().alias("vw"[i - 1])] if orders else [F.col("k1").alias(f"r{i}"), key().alias("vw"[i - 1])]), F.size("tokens").alias(f"n_{i}"), F.col("tokens").alias(f"tokens_{i}"))
        found = found.join(own, "vw"[i - 1] if orders else f"r{i}")
    common = F.size(F.array_intersect("tokens_1", "tokens_2"))
    return found.where((F.col("v") != F.col("w")) & (common * (rule.a + rule.b) >= (F.col("n_1") + F.col("n_2")) * rule.a)).select("v", "w").distinct()


def within(sets: DataFrame, rule: Rule, orders: int) -> DataFrame:
    """v, others, p of the classes in sets (g, k1, k2, n, members, blocks, tokens) that link with one of their cluster.

    others: members of the classes it links with; p: a class that links reach it from, null for one of each group
    so connected. Each two blocks of a cluster are compared in a task; it gives a row a class, however many
    links there are.
    """
    own = F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int")
    rows = sets.select("g", "k1", "k2", "n", "members", "tokens", "blocks", own.alias("b"))
    small = rows.where("blocks = 1").withColumns({"b1": F.lit(0), "b2": F.lit(0)})
    large = rows.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumns({"b1": F.least("b", "other"), "b2": F.greatest("b", "other")}).drop("other")
    dealt = small.unionByName(large).drop("blocks").repartition("g", "b1", "b2").sortWithinPartitions("g", "b1", "b2", "n", "k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("g", "b1", "b2"), 512):
            k1, k2, n, members, b = (table[c].to_numpy() for c in ("k1", "k2", "n", "members", "b"))
            tokens = pc.list_flatten(table["tokens"]).to_numpy().view(np.uint64)
            start = np.cumsum(n) - n
            begin, end = group_ends(*(table[c].to_numpy() for c in ("g", "b1", "b2")))
            cross = table["b1"].to_numpy() != table["b2"].to_numpy()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i in np.unique(begin).tolist():
                at = np.arange(i, end[i])
                at = at[np.concatenate([[True], (k1[at[1:]] != k1[at[:-1]]) | (k2[at[1:]] != k2[at[:-1]])])]  # repeated rows
                if len(at) < 2:
                    continue
                others, up = linked(n[at], tokens[spans(start[at], n[at])], members[at], b[at] if cross[i] else None, rule, orders)
                hit = np.flatnonzero(others)
                out.append((at[hit], others[hit], at[up[hit]]))
            if out:
                own, others, up = map(np.concatenate, zip(*out, strict=True))
                keys = [pa.StructArray.from_arrays([pa.array(k1[x]), pa.array(k2[x])], ["k1", "k2"], mask=pa.array(m)) for x, m in ((own, np.zeros(len(own), bool)), (up, up == own))]
                yield pa.RecordBatch.from_arrays([keys[0], pa.array(others), keys[1]], names=["v", "others", "p"])
        trim()

    return dealt.mapInArrow(run, "v struct<k1: long, k2: long>, others long, p struct<k1: long, k2: long>")


def incidence(own: np.ndarray, what: np.ndarray, m: int) -> np.ndarray:
    """A row of bits for each of m sets: which of the tokens that several have."""
    width = -(-(int(what.max()) + 1) // 64) if len(what) else 1
    bits = np.zeros((m, width), np.uint64)
    np.bitwise_or.at(bits, (own, what >> 6), np.uint64(1) << (what & 63).astype(np.uint64))
    return bits


def linked(n: np.ndarray, tokens: np.ndarray, members: np.ndarray, block: np.ndarray | None, rule: Rule, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets that ascend by size: the members of those that each links with, and one set of its connected group.

    Pairs (of different blocks, if given) must share a prefix token under the rarity order and under each of
    the further orders; then the sets are compared.
    """
    m = len(n)
    own, start, count = np.repeat(np.arange(m), n), np.cumsum(n) - n, rule.prefix(n)
    _, ids, times = np.unique(tokens, return_inverse=True, return_counts=True)
    ids = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[ids]  # numbers of the tokens that several have
    prefix = spans(start, count)
    places = [prefix, *(by_order(tokens, own, i)[1][prefix] for i in range(orders))]
    sieves = []
    for at in places:
        at = at[ids[at] >= 0]
        present, number = np.unique(ids[at], return_inverse=True)
        sieves.append(incidence(own[at], number, m))
    several = ids >= 0
    bits = incidence(own[several], ids[several], m)
    others, group = np.zeros(m, np.int64), np.arange(m)
    end = np.searchsorted(n * rule.a, n * rule.b, side="right")
    for i in range(m - 1):
        j = np.arange(i + 1, end[i])
        if block is not None:
            j = j[block[j] != block[i]]
        for sieve in sieves:
            j = j[(sieve[j] & sieve[i]).any(axis=1)]
        if not len(j):
            continue
        common = np.bitwise_count(bits[j] & bits[i]).sum(axis=1, dtype=np.int64)
        j = j[common >= rule.overlap(n[j] + n[i])]
        if not len(j):
            continue
        others[i] += members[j].sum()
        others[j] += members[i]
        low = min(group[i], group[j].min())
        if group[i] != low or (group[j] != low).any():
            group[np.isin(group, np.append(group[j], group[i]))] = low
    return others, group


def components(edges: DataFrame) -> DataFrame:
    """v, c: each vertex of the edges (v, w) with the smallest vertex it reaches, by alternating large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("w", "v")) if large else e
        near = both.where("v <> w")
        if not large:
            near = near.select(F.greatest("v", "w").alias("v"), F.least("v", "w").alias("w"))
        least = near.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m"))
        out = near.join(least, "v")
        if large:
            return out.where("w > v").select(F.col("w").alias("v"), F.col("m").alias("w")).where("v <> w").distinct()
        return out.select(F.col("w").alias("v"), F.col("m").alias("w")).union(least.select("v", F.col("m").alias("w"))).where("v <> w").distinct()

    current, before = materialise(edges.select("v", "w").distinct(), "edges"), None
    while True:
        state = current.select(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(v, w))"), F.sum(F.hash("v", "w").cast("long"))).first()
        if state == before or not state[0]:
            break
        before, old = state, current
        current = materialise(star(star(old, True), False), "edges")
        release(old)
    return current.select("v", F.col("w").alias("c")).union(current.select(F.col("w"), F.col("w"))).distinct()


def begin(docs: DataFrame, rule: Rule) -> tuple:
    """What both joins start from: the rarity table, the records, and of each class the first record and the number."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rarity = spark.sparkContext.broadcast(rarity_table(docs, rule))  # rule.slots bytes whatever the input
    found = materialise(scan(docs, rule, rarity), "records")
    first = found.where("d IS NOT NULL AND n > 0").groupBy("k1", "k2").agg(F.min(F.struct("d", "l")).alias("f"), F.max("n").alias("n"), F.count(F.lit(1)).alias("members")).selectExpr("k1", "k2", "f.d AS d", "f.l AS l", "n", "members")
    return rarity, found, first
