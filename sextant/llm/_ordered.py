"""Numbering and running sums within groups of any size: rows are dealt by range, not by group.

A window over a group runs in one task, however large the group. Here the table is sorted by (group, order)
over all tasks; each task numbers its rows, and what a group has in earlier tasks is added afterwards. Only
groups at a task's ends reach beyond it, so that needs two rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import materialise, prepare

_NEW = [("_task", T.IntegerType()), ("_k", T.LongType()), ("_sum", T.LongType()), ("_weighted", T.LongType()), ("_first", T.BooleanType()), ("_edge", T.BooleanType())]


def group_codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values of a batch; nulls are equal to one another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.cast(column.dictionary_encode(null_encoding="encode").indices, pa.int64()), -1).to_numpy(zero_copy_only=False)


def starts(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers start."""
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1]) if len(codes) else np.zeros(0, np.int64)


def _running(x: np.ndarray, begin: np.ndarray, run: np.ndarray, carried: int) -> np.ndarray:
    """Sums from the start of each run (run: its number, row by row); the first run goes on from carried. Modulo 2^64."""
    total = np.cumsum(x, dtype=np.int64)
    before = np.concatenate([[0], total[begin[1:] - 1]]) if len(begin) else total[:0]
    before[:1] -= carried
    return total - before[run]


def _numbered(group: str, value: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        k = total = weighted = 0
        open_first, held, held_columns = True, None, None

        def done(ends_group: bool, last: bool) -> pa.RecordBatch:
            task_, ks, sums, ws, first, tail = held_columns
            tail = tail.copy()
            tail[-1] = ends_group
            edge = tail & first
            edge[-1] |= last
            columns = [pa.array(np.full(len(ks), task_, np.int32)), pa.array(ks), pa.array(sums), pa.array(ws), pa.array(first), pa.array(edge)]
            return pa.RecordBatch.from_arrays([*held.columns, *columns], names=[*held.schema.names, *(n for n, _ in _NEW)])

        last_key = None
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = batch.column(group)
                codes = group_codes(keys)
                same = held is not None and keys[0].as_py() == last_key
                if held is not None:
                    yield done(not same, False)
                begin = starts(codes)
                row = np.zeros(len(codes), np.int64)
                row[begin[1:]] = 1
                row = np.cumsum(row)
                if not same:
                    k = total = weighted = 0
                    open_first = held is None
                ks = _running(np.ones(len(codes), np.int64), begin, row, k)
                x = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64) if value else np.zeros(len(codes), np.int64)
                sums, ws = _running(x, begin, row, total), _running(ks * x, begin, row, weighted)
                first = (row == 0) & open_first
                tail = np.zeros(len(codes), bool)
                tail[begin[1:] - 1] = True
                k, total, weighted = int(ks[-1]), int(sums[-1]), int(ws[-1])
                open_first &= len(begin) == 1
                held, held_columns, last_key = batch, (task, ks, sums, ws, first, tail), keys[len(keys) - 1].as_py()
            if held is not None:
                yield done(True, True)

    return run


def wrapped(x: Column) -> Column:
    """A whole decimal as a long, modulo 2^64 as longs are added in most languages."""
    half, full = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return (F.pmod(x + half, full) - half).cast("long")


def numbered(df: DataFrame, group: str, order: list[str], rank: str, value: str | None = None, state: str | None = None) -> DataFrame:
    """df with rank, from 1 within each group by order; with state, the sum of rank * value up to each row, modulo 2^64.

    Order must tell rows apart, or those it doesn't must be alike. Null groups are one group. value: whole numbers, no nulls.
    """
    spark = df.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in _NEW)])
    rows = materialise(dealt.mapInArrow(_numbered(group, value), schema), "numbered")
    # of each task: the group that may go on from earlier tasks, and the one that later tasks may go on with
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    decimal = lambda c: F.col(c).cast("decimal(38,0)")
    ends = rows.where("_edge").select(group, "_task", "_k", "_sum", "_weighted", "_first")
    ends = ends.withColumn("_k0", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).cast("long"))
    ends = ends.withColumn("_s0", F.coalesce(F.sum((decimal("_k0") * decimal("_sum")).cast("decimal(38,0)") + decimal("_weighted")).over(earlier), F.lit(0)).cast("decimal(38,0)"))
    ends = ends.where("_first and _k0 > 0").select(F.col("_task").alias("_t"), "_k0", "_s0")
    out = rows.join(ends, F.when(F.col("_first"), F.col("_task")) == F.col("_t"), "left")
    new = {rank: F.col("_k") + F.coalesce("_k0", F.lit(0))}
    if state:
        moved = (decimal("_k0") * decimal("_sum")).cast("decimal(38,0)") + decimal("_s0") + decimal("_weighted")
        new[state] = F.when(F.col("_k0").isNull(), F.col("_weighted")).otherwise(wrapped(moved.cast("decimal(38,0)")))
    return out.select(*df.columns, *(c.alias(n) for n, c in new.items()))
