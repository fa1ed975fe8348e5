"""Session helpers shared by the operators: scratch tables, Arrow batch size, column lists."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch: texts can be long, and a batch must fit a worker's memory.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches for tables of texts. The session keeps the bounds: results are worked out later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the setting is absent and all run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder by Hadoop's file system, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim() -> None:
    """Give a worker's freed memory back: it waits for its next task beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def gone():
        try:
            delete_path(spark, path)
        except Exception:  # the session may have stopped before
            return

    atexit.register(gone)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again: cuts the lineage, outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # hashes and texts repeat too little for dictionaries
    df.write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._scratch)


def forget(spark: SparkSession) -> None:
    """Let the driver drop plans that are done with: Spark then deletes their shuffle files, now and not at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_columns(schema: T.StructType, new: list[tuple[str, T.DataType]]) -> T.StructType:
    """schema with the new columns; those of the same name (whatever its case) are replaced."""
    names = {n.lower() for n, _ in new}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + [T.StructField(n, t) for n, t in new])


def replaced(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """batch with the new columns, in the order that with_columns gives."""
    names = {n.lower() for n in new}
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in names]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(new.values()), names=[n for n, _ in kept] + list(new))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df has not, whatever their case."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in there:
            name = f"_{name}"
        there.add(name.lower())
        out.append(name)
    return out
