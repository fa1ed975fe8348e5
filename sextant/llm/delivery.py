"""Replay of turns that arrive, fail, are retried and hold back their children (operator 13).

The turns of a conversation, numbered from 0, arrive every EVERY seconds. Hashes of their keys say which turn
is the parent (one or two earlier, or none), whether a turn is faulty and when it is repaired, and which later
attempts fail. How many attempts a turn takes is not simulated: attempt a (from 0) comes STEP * (2^a - 1)
seconds after the first, so an integer logarithm gives the first attempt after the repair, and the trailing
ones of the failure mask, shifted by it, those that fail after it. Turns are evaluated in topological order,
all turns of one depth of all conversations of a batch at once.

A conversation may hold any part of the rows, so nothing is dealt by conversation alone. Turns are numbered, and
releases summed up, by ranges (_ordered). For the evaluation each conversation is cut into blocks of turns;
a block's task also gets the turns just before it, far enough back for every chain of parents to reach its start.
Blocks where a chain goes on further are evaluated again with more turns before them, until none is left.

Rows: turns are ordered by turn, nulls first, then by text hash; rows that repeat a turn are turns of their own, in
that order. A null conversation id is a conversation of its own; a null conv_id or turn stands as nothing in the hashed
key. A null text has the hash of an empty one. state is kept modulo 2^64, as a long. Other columns of the input
are not read. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._ordered import group_codes, numbered, starts
from ._runtime import materialise

EVERY, FAULTY_OF_101, STEP, ATTEMPTS = 7, 35, 10, 5
#: Turns of a block, and turns before it that its task gets at first.
BLOCK, BEFORE = 128, 64
DELIVERED, DEAD, BLOCKED = 1, 2, 3
STATUS = ["", "delivered", "dead", "blocked"]


def bit_length(n: np.ndarray) -> np.ndarray:
    """Bits of whole numbers below 2^53."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def attempts(first_at: np.ndarray, repaired_at: np.ndarray, mask: np.ndarray, faulty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status, number of attempts and time of the last, of turns whose first attempt is known. Bit a of mask: attempt a, from 0, fails."""
    # attempt a is at first_at + STEP * (2^a - 1): the first at or after the repair
    wait = np.maximum(repaired_at - first_at, 0)
    repaired = np.where(faulty, bit_length(-(-wait // STEP)), 0)
    fails = np.where(faulty, mask, 0) >> repaired
    passed = ~fails  # its lowest set bit is the first attempt that gets through
    tried = repaired + bit_length(passed & -passed) - 1
    dead = tried >= ATTEMPTS
    number = np.where(dead, ATTEMPTS, tried + 1)
    return np.where(dead, DEAD, DELIVERED), number, first_at + STEP * ((1 << (number - 1)) - 1)


def evaluate(block: np.ndarray, p: np.ndarray, distance: np.ndarray, delay: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Results of turns that lie by block and p; status 0 where the chain of parents leaves the block's first turn.

    delay: seconds from arrival to repair, below 0 for turns that aren't faulty.
    """
    n = len(p)
    begin = starts(block)
    run = np.zeros(n, np.int64)
    run[begin[1:]] = 1
    start = begin[np.cumsum(run)]
    has_parent = (distance > 0) & (distance <= p)
    parent = np.where(has_parent, np.arange(n) - distance, -1)
    outside = has_parent & (parent < start)
    status, number, first, last = (np.zeros(n, np.int64) for _ in range(4))
    arrival = EVERY * p
    settled = np.zeros(n, bool)
    ready, todo = np.flatnonzero(~has_parent), np.flatnonzero(has_parent & ~outside)
    while len(ready):
        up = parent[ready]
        after = np.where(up >= 0, last[up], 0)
        held = (up >= 0) & (status[up] != DELIVERED)
        first[ready] = np.maximum(arrival[ready], after)
        status[ready], number[ready], last[ready] = attempts(first[ready], arrival[ready] + delay[ready], mask[ready], delay[ready] >= 0)
        status[ready[held]], number[ready[held]] = BLOCKED, 0
        settled[ready] = True
        now = settled[parent[todo]]
        ready, todo = todo[now], todo[~now]
    return {"status": status, "attempts": number, "first_at": first, "last_at": last}


def _results(own: str):
    """Evaluate sorted rows, whole blocks at a time, and pass on those of the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if not table.num_rows:
                return
            column = lambda name: table.column(name).to_numpy().astype(np.int64)
            conv, block = group_codes(table.column("conv")), column("block")
            same = np.zeros(table.num_rows, np.int64)
            same[1:] = (np.diff(conv) != 0) | (np.diff(block) != 0)
            same = np.cumsum(same)
            found = evaluate(same, column("p"), column("distance"), column("delay"), column("mask"))
            inner = column(own) == block
            # a block with an open turn is evaluated again as a whole
            unsettled = np.bincount(same, weights=(found["status"] == 0) & inner)[same] > 0
            out = table.select(["conv", "turn", "p", "crc", "block"])
            for name, values in found.items():
                out = out.append_column(name, pa.array(values))
            out = out.append_column("again", pa.array(unsettled)).filter(pa.array(inner))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            conv, block = group_codes(table.column("conv")), table.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(conv) != 0) | (np.diff(block) != 0))
            if len(cuts):  # what follows the last cut may go on in the next batch
                cut = int(cuts[-1]) + 1
                yield from solved(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held))

    return run


def _blocks(turns: DataFrame, block: int, before: int, only: DataFrame | None = None) -> DataFrame:
    """Results of the turns of each block (of those in only), evaluated with the turns up to before earlier."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = F.sequence(F.expr(f"p div {block}"), F.expr(f"(p + {before}) div {block}"))
    rows = turns.withColumn("own", F.expr(f"p div {block}")).withColumn("block", F.explode(reach))
    if only is not None:
        rows = rows.join(only, rows["conv"].eqNullSafe(only["c"]) & (rows["block"] == only["b"]), "left_semi")
    rows = rows.repartition(n, "conv", "block").sortWithinPartitions("conv", "block", "p")
    kind = turns.schema["conv"].dataType.simpleString(), turns.schema["turn"].dataType.simpleString()
    schema = f"conv {kind[0]}, turn {kind[1]}, p long, crc long, block long, status long, attempts long, first_at long, last_at long, again boolean"
    return materialise(rows.mapInArrow(_results("own"), schema), "replayed")


def replay(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK, before: int = BEFORE) -> DataFrame:
    """conv, turn, status, attempts, first_at, last_at, release_no and state of every turn."""
    slim = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("row"))
    slim = numbered(slim, "conv", ["turn", "crc", "row"], "number")  # row: else all rows that repeat a turn meet in one task
    empty = F.lit("")
    h = lambda k: F.crc32(F.concat_ws(":", F.lit(str(k)), F.coalesce(F.col("conv").cast("string"), empty), F.coalesce(F.col("turn").cast("string"), empty)).cast("binary"))
    mask = F.lit(0)
    for a in range(ATTEMPTS):
        mask = mask.bitwiseOR(F.shiftleft((h(a + 3) % 3 == 0).cast("int"), a))
    slim = slim.select(
        "conv",
        "turn",
        "crc",
        (F.col("number") - 1).alias("p"),
        (h(0) % 3).cast("int").alias("distance"),
        F.when(h(1) % 101 < FAULTY_OF_101, h(2) % 101).otherwise(-1).cast("int").alias("delay"),
        mask.alias("mask"),
    )
    found = _blocks(slim, block, before)
    done = found.where("not again")
    while not (again := found.where("again")).isEmpty():
        before *= 16
        found = _blocks(slim, block, before, again.select(F.col("conv").alias("c"), F.col("block").alias("b")).distinct())
        done = done.union(found.where("not again"))
    released = numbered(done.where(F.col("status") == DELIVERED), "conv", ["last_at", "turn", "p"], "release_no", "crc", "state")
    rest = done.where(F.col("status") != DELIVERED)
    # what a blocked turn would have had is not there
    rest = rest.withColumns({"release_no": F.lit(None).cast("long"), "state": F.lit(None).cast("long")} | {c: F.when(F.col("status") != BLOCKED, F.col(c)) for c in ("first_at", "last_at")})
    names = F.array(*map(F.lit, STATUS))
    return released.unionByName(rest).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), names[F.col("status").cast("int")].alias("status"), F.col("attempts").cast("int"), "first_at", "last_at", "release_no", "state"
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = """
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations),
strings AS (
  SELECT conv_id, turn, k, hex(encode(CASE WHEN k < 8 THEN concat(k, ':', conv_id, ':', turn) ELSE text END)) AS x FROM turns, range(9) r(k)),
crcs AS (
  SELECT conv_id, turn, k,
         xor(list_reduce([4294967295] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM strings, crc_table),
hashes AS (SELECT conv_id, turn, list(h ORDER BY k) AS h FROM crcs GROUP BY ALL),
all_turns AS (
  SELECT conv_id, turn, p, h[9] AS crc, 7 * p AS arrival, h[2] % 101 < 35 AS faulty, 7 * p + h[3] % 101 AS repaired, h,
         CASE WHEN h[1] % 3 BETWEEN 1 AND p THEN p - h[1] % 3 END AS parent
  FROM turns JOIN hashes USING (conv_id, turn)),
done AS (
  SELECT conv_id, p, arrival AS first_at, list_filter([1, 2, 3, 4, 5], lambda a: NOT faulty OR (arrival + 10 * (2 ** (a - 1) - 1) >= repaired AND h[a + 3] % 3 <> 0))[1] AS passed, false AS blocked
  FROM all_turns WHERE parent IS NULL
  UNION ALL
  SELECT conv_id, p, s, list_filter([1, 2, 3, 4, 5], lambda a: NOT faulty OR (s + 10 * (2 ** (a - 1) - 1) >= repaired AND h[a + 3] % 3 <> 0))[1], blocked
  FROM (SELECT c.*, d.blocked OR d.passed IS NULL AS blocked, greatest(c.arrival, d.first_at + 10 * (2 ** (d.passed - 1) - 1))::BIGINT AS s
        FROM done d JOIN all_turns c ON c.conv_id = d.conv_id AND c.parent = d.p)),
results AS (
  SELECT conv_id, turn, crc, CASE WHEN blocked THEN 'blocked' WHEN passed IS NULL THEN 'dead' ELSE 'delivered' END AS status,
         CASE WHEN blocked THEN 0 ELSE coalesce(passed, 5) END::INTEGER AS attempts,
         CASE WHEN NOT blocked THEN first_at END AS first_at,
         CASE WHEN NOT blocked THEN (first_at + 10 * (2 ** (coalesce(passed, 5) - 1) - 1))::BIGINT END AS last_at
  FROM done JOIN all_turns USING (conv_id, p)),
released AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, turn) AS release_no FROM results WHERE status = 'delivered')
SELECT conv_id, turn, status, attempts, first_at, last_at, release_no,
       (sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no))::BIGINT AS state
FROM released
UNION ALL
SELECT conv_id, turn, status, attempts, first_at, last_at, NULL, NULL FROM results WHERE status <> 'delivered'
"""
