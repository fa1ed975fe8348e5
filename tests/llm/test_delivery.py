"""The replay against a simulation turn by turn."""

import random
import zlib

import numpy as np
import pytest

from sextant.llm import _ordered, delivery

SCHEMA = "conv_id long, turn long, role string, text string"


def crc(s):
    return zlib.crc32(s.encode())


def wrap(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def brute(rows):
    show = lambda x: "" if x is None else str(x)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, crc(r[3] or "")))
        results = []
        for p, (_, turn, _, text) in enumerate(own):
            h = lambda k: crc(f"{k}:{show(conv)}:{show(turn)}")  # noqa: B023, E731
            back = h(0) % 3
            parent = results[p - back] if 0 < back <= p else None
            if parent and parent["status"] != "delivered":
                results.append({"status": "blocked", "attempts": 0, "first": None, "last": None})
                continue
            at = first = max(7 * p, parent["last"] if parent else 0)
            faulty, repaired = h(1) % 101 < 35, 7 * p + h(2) % 101
            status = "dead"
            for a in range(1, 6):
                if not (faulty and (at < repaired or h(a + 2) % 3 == 0)):
                    status = "delivered"
                    break
                if a < 5:
                    at += 10 * 2 ** (a - 1)
            results.append({"status": status, "attempts": a, "first": first, "last": at})
        state = 0
        order = sorted((k for k, r in enumerate(results) if r["status"] == "delivered"), key=lambda k: (results[k]["last"], own[k][1] is not None, own[k][1] or 0, k))
        for n, k in enumerate(order, 1):
            state += n * crc(own[k][3] or "")
            results[k] |= {"no": n, "state": wrap(state)}
        out += [(conv, own[k][1], r["status"], r["attempts"], r["first"], r["last"], r.get("no"), r.get("state")) for k, r in enumerate(results)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(chance, sizes):
    return [(conv, turn, "user", chance.choice(["", None, "é", f"text {turn}"])) for conv, n in sizes.items() for turn in range(n)]


@pytest.mark.parametrize(("block", "before"), [(128, 64), (4, 2), (1, 1)])
def test_as_a_simulation(spark, block, before):
    chance = random.Random(block)
    data = made(chance, {1: 1, 2: 700, 3: 8, 4: 129, None: 5, 6: 64})
    data += [(3, 2, "user", "again"), (3, 2, "user", "again"), (7, None, "user", "x"), (7, 4, None, None), (7, 9, None, "gap")]
    chance.shuffle(data)
    assert rows_of(delivery.replay(spark.createDataFrame(data, SCHEMA).repartition(5), block=block, before=before)) == brute(data)


def test_most_rows_in_one_conversation_or_turn(spark):
    chance = random.Random(3)
    data = made(chance, {k: 2 for k in range(50)} | {99: 3000}) + [(99, 40, "user", "same")] * 300
    assert rows_of(delivery.replay(spark.createDataFrame(data, SCHEMA).repartition(4))) == brute(data)


def test_empty_table_and_clashing_columns(spark):
    assert rows_of(delivery.replay(spark.createDataFrame([], SCHEMA))) == []
    data = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "user", "c")]
    frame = spark.createDataFrame(data, SCHEMA).selectExpr("*", "7 AS conv", "8 AS p", "'z' AS status", "9 AS block", "1 AS _task", "2 AS release_no")
    assert rows_of(delivery.replay(frame)) == brute(data)


def test_ids_of_other_types_and_a_very_long_text(spark):
    data = [("c", 0, "user", "a" * 5_000_000), ("c", 1, "user", "b"), ("d", 0, "user", None)]
    assert rows_of(delivery.replay(spark.createDataFrame(data, "conv_id string, turn int, role string, text string"))) == brute(data)


def test_attempts_as_a_loop():
    first, wait, mask = (x.ravel() for x in np.meshgrid([0, 3], np.arange(-5, 101), np.arange(32), indexing="ij"))
    for faulty in (False, True):
        status, number, last = delivery.attempts(first, first + wait, mask, np.full(len(mask), faulty))
        for k in range(len(mask)):
            at = first[k]
            for a in range(1, 6):
                if not faulty or (at >= first[k] + wait[k] and not mask[k] >> (a - 1) & 1):
                    assert (status[k], number[k], last[k]) == (delivery.DELIVERED, a, at)
                    break
                at += 10 * 2 ** (a - 1) if a < 5 else 0
            else:
                assert (status[k], number[k], last[k]) == (delivery.DEAD, 5, at)


def test_sums_beyond_a_long_are_kept_modulo(spark):
    data = [(1, k, 4294967295 << 20) for k in range(5000)]
    frame = spark.createDataFrame(data, "g int, k long, v long").repartition(7)
    got = {r["k"]: (r["n"], r["s"]) for r in _ordered.numbered(frame, "g", ["k"], "n", "v", "s").collect()}
    total = 0
    for k in range(5000):
        total += (k + 1) * (4294967295 << 20)
        assert got[k] == (k + 1, wrap(total))
