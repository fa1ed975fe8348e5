"""Benchmark decontamination, with DataFrame operations only (operator 8).

Words are lower-cased (A-Z) runs without white space; shingles are five words, and an item or window
is the multiset of its shingles. A document's windows have an item's number of words (cut off at the
text's ends) and start anywhere; those that hold as many of an item's shingles as the similarity
asks for, in any order, are found by an equi-join on shingles. Such a window and its item get 64-bit
SimHashes; these are cut into RADIUS + 1 blocks, so any two fingerprints within RADIUS agree in a block
and meet in an equi-join on it. Those within RADIUS are compared exactly: weighted Jaccard, each
shingle weighing its number of occurrences, of at least 4/5.
Bits of fingerprints at the threshold differ with a chance of 0.15 to 0.19 (the most where a window is cut at
the text's end), 12 of 64 on average (deviation 3.2): RADIUS lies six deviations above, so that a
pair gets lost with a chance of about 1e-10.

Windows beside a leak are leaks as well. Rows are the leaks that have a shingle where the item has it, as
OP8_SQL defines them; of windows that reach the similarity without such a shingle (an item with parts
swapped), OP8_SQL has none, and one row, the most similar, stands for each run of starts.

Items of fewer than five words, null texts and null item ids match nothing. Null doc_ids take part
as their own document; rows that repeat an id and text count once, as do repeated items. Item
shingles are broadcast only while there are at most BROADCAST_SHINGLES of them, texts' hits only while these are
of BROADCAST_TEXTS texts; beyond, they are joined by shuffle. Very long texts are split as a whole, in one row's
memory. Columns other than ids and texts pass through clean() and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._runtime import materialise, unused

K, RADIUS, BITS = 5, 32, 64
LEAST = 0.8
#: Shingles of items, and texts with hits, that are broadcast at most.
BROADCAST_SHINGLES, BROADCAST_TEXTS = 200_000, 20_000
#: Bytes between words.
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The array of words; no empty ones at the ends."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda w: w != "")


def shingles(w: Column) -> Column:
    """The hash of the K words from each word on."""
    last = F.size(w) - K
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))).otherwise(F.array().cast("array<bigint>"))


def simhash(h: Column) -> Column:
    """Bit b is set where more than half of the hashes have it."""
    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(h, F.lit(0).cast("bigint"), lambda n, x: n + F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1).cast("bigint")))
        return F.when(ones * 2 > F.size(h), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))).otherwise(acc)

    # never null, or the optimizer would infer a test for null and push it down to the text
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), bit), F.lit(0).cast("bigint"))


def blocks(fingerprint: Column) -> Column:
    """(block, value) of the RADIUS + 1 blocks that the bits are cut into."""
    cuts = [i * BITS // (RADIUS + 1) for i in range(RADIUS + 2)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def counted(ordered: Column) -> Column:
    """A sorted multiset of hashes as a set: each with the number of its occurrence."""
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(ordered, x)))


def prepared_items(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w"))
    rows = rows.select("item_id", F.size("w").alias("m"), shingles(F.col("w")).alias("h")).distinct()
    return rows.withColumns({"item_hash": simhash(F.col("h")), "item_set": F.array_sort("h")}).withColumn("item_set", counted(F.col("item_set")))


def starts(places: Column, size: Column, least: float) -> Column:
    """All starts whose window of size shingles holds at least least * size of the sorted places, each once.

    A window with n of them in common is at most n / size similar to its item, so no other start reaches
    least. Those at places i to i + need - 1 fit windows from the last one's end to the first one's start;
    what lies before place i - 1 is left to it.
    """
    need = F.greatest(F.ceil(size * F.lit(least) - F.lit(1e-6)), F.lit(1)).cast("int")

    def span(i: Column) -> Column:
        low = F.greatest(F.get(places, i + need - 1) - size + 1, F.coalesce(F.get(places, i - 1) + 1, F.lit(-(1 << 31)).cast("int")))
        return F.when(low <= F.get(places, i), F.sequence(low, F.get(places, i))).otherwise(F.array().cast("array<int>"))

    last = F.size(places) - need
    return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), span))).otherwise(F.array().cast("array<int>"))


def sized(rows: DataFrame) -> DataFrame:
    """rows of texts, broadcast if they are few: texts are not shuffled for them; more are joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_TEXTS else rows


def windows(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, th, item_id, m, start, the sorted shingles of each window with enough of the item's, and
    whether one of them stands as in the item.

    The outer form of posexplode keeps the optimizer from inferring a filter on the array's size,
    which would split the text again for every word; the null row it adds joins nothing.
    """
    places = items.select("item_id", "m", F.posexplode_outer("h").alias("q", "s"))
    if places.count() <= BROADCAST_SHINGLES:
        places = F.broadcast(places)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).select("doc_id", "th", shingles(F.col("w")).alias("h"))
    hits = rows.select("doc_id", "th", F.posexplode_outer("h").alias("pos", "s")).join(places, "s")
    held = hits.groupBy("doc_id", "th", "item_id", "m").agg(F.array_sort(F.collect_set("pos")).alias("places"), F.collect_set(F.col("pos") - F.col("q")).alias("inplace"))
    held = held.withColumn("starts", starts(F.col("places"), F.col("m") - K + 1, least)).where(F.size("starts") > 0)
    found = held.groupBy(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th")).agg(F.collect_list(F.struct("item_id", "m", "starts", "inplace")).alias("held"))
    # the few texts left are split again, each once
    left = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(sized(materialise(found, "held")), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")))
    left = left.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "held", words(F.col("text")).alias("w")).select("doc_id", "th", "held", shingles(F.col("w")).alias("h"))
    left = left.select("doc_id", "th", "h", F.inline_outer("held")).select("doc_id", "th", "h", "item_id", "m", "inplace", F.explode_outer("starts").alias("start"))
    cut = F.slice("h", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("m") - K + 1 + F.least(F.col("start"), F.lit(0)))
    return left.select("doc_id", "th", "item_id", "m", "start", F.array_contains("inplace", F.col("start")).alias("aligned"), F.array_sort(cut).alias("win"))


def distinct_places(found: DataFrame) -> DataFrame:
    """The aligned windows, and of each run of starts without one the most similar, the first of equals,
    unless it overlaps an aligned one."""
    key = ["doc_id", "th", "item_id", "m"]
    by = Window.partitionBy(key).orderBy("start")
    inplace = F.when(F.col("aligned"), F.col("start"))
    found = found.withColumns({"run": F.col("start") - F.dense_rank().over(by), "before": F.max(inplace).over(by.rowsBetween(Window.unboundedPreceding, 0)), "after": F.min(inplace).over(by.rowsBetween(0, Window.unboundedFollowing))})
    best = F.max(F.struct(F.col("similarity"), -F.col("start"))).over(Window.partitionBy(*key, "run"))
    clear = F.coalesce(F.col("start") - F.col("before") >= F.col("m"), F.lit(True)) & F.coalesce(F.col("after") - F.col("start") >= F.col("m"), F.lit(True))
    found = found.withColumn("best", F.struct(F.col("similarity"), -F.col("start")) == best)
    return found.where(F.col("aligned") | (F.col("best") & clear))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, th (hash of the text), item_id, start (word number), n_words, hamming and similarity of each leak."""
    items = prepared_items(benchmark)
    found = windows(docs.where("text IS NOT NULL"), items, least).where(F.size("win") > 0)
    prints = found.withColumn("print", simhash(F.col("win")))
    key = ["item_id", "block", "value"]
    left = prints.select("*", F.inline(blocks(F.col("print"))))
    right = items.select("item_id", "item_hash", F.inline(blocks(F.col("item_hash"))))
    near = left.join(right, key).withColumn("hamming", F.bit_count(F.col("print").bitwiseXOR(F.col("item_hash")))).where(F.col("hamming") <= RADIUS)
    near = near.groupBy("doc_id", "th", "item_id", "m", "start", "aligned").agg(F.any_value("win").alias("win"), F.any_value("hamming").alias("hamming"))
    out = near.join(items.select("item_id", "m", "item_set"), ["item_id", "m"])
    common = F.size(F.array_intersect(counted(F.col("win")), "item_set"))
    similarity = common / (F.size("win") + F.size("item_set") - common)
    out = distinct_places(out.withColumn("similarity", similarity.cast("double")).where(F.col("similarity") >= least))
    return out.select("doc_id", "th", "item_id", F.col("start").cast("int").alias("start"), F.col("m").alias("n_words"), F.col("hamming").cast("int").alias("hamming"), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a leak; other columns pass through, null ids and texts are kept by their own text."""
    d, th = unused(docs, "d", "th")
    bad = materialise(leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(d), F.col("th").alias(th)).distinct(), "leaks")
    return docs.join(sized(bad), F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "start", "n_words", "similarity")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Leaks of {docs}: (doc_id, item_id, start, n_words, similarity).
LEAKS_SQL = (
    """
bw AS MATERIALIZED (SELECT item_id, """
    + _WORDS.format("text")
    + """ AS w FROM benchmark),
bs AS MATERIALIZED (SELECT item_id, len(w) AS m, i - 1 AS q, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw WHERE len(w) >= 5)),
dw AS MATERIALIZED (SELECT doc_id, """
    + _WORDS.format("text")
    + """ AS w FROM {docs}),
ds AS MATERIALIZED (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
win AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, m, pos - q AS start FROM ds JOIN bs USING (s)),
wc AS (SELECT win.doc_id, item_id, start, m, s, count(*) AS n FROM win JOIN ds ON ds.doc_id = win.doc_id AND pos >= start AND pos <= start + m - 5 GROUP BY ALL),
bc AS (SELECT item_id, s, count(*) AS n FROM bs GROUP BY ALL),
ws AS (SELECT doc_id, item_id, start, m, sum(n) AS total FROM wc GROUP BY ALL),
wi AS (SELECT doc_id, item_id, start, sum(least(wc.n, bc.n)) AS common FROM wc JOIN bc USING (item_id, s) GROUP BY ALL),
leak AS MATERIALIZED (SELECT doc_id, item_id, start::INT AS start, m::INT AS n_words, (common / (total + m - 4 - common))::DOUBLE AS similarity
  FROM wi JOIN ws USING (doc_id, item_id, start) WHERE common / (total + m - 4 - common) >= 0.8)
"""
)
OP8_SQL = "WITH " + LEAKS_SQL.format(docs="documents") + "SELECT doc_id, item_id, start, n_words, similarity FROM leak"
