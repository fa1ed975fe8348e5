"""Tables stored by pipeline version and version bucket, of which a reindex rewrites only the partitions it touches.

A row belongs to the partition of its pipeline version and of a hash bucket of its version. Replacing some versions reads the
partitions that these lie in, leaves out their old rows, adds the new ones, and overwrites these partitions; files of all others
stay as they are. The new state is written beside the table first, so a run that fails before the last step changes nothing,
and a repeated run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

BUCKETS = 64
KEYS = ("pipeline_version", "bucket")


def bucket_of(version_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(version_id), F.lit(buckets)).cast("int")


class PartitionedTable:
    """Rows with version_id and pipeline_version under a path; schema: their columns."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def _stored(self) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self, pipeline_version: str | None = None, version_ids: list[str] | None = None) -> DataFrame:
        """All rows, or those of one pipeline version or of some versions: only their partitions are read."""
        rows = self._stored()
        if pipeline_version is not None:
            rows = rows.where(F.col("pipeline_version") == pipeline_version)
        if version_ids is not None:
            numbers = self.spark.createDataFrame([(v,) for v in version_ids], "v string").select(bucket_of(F.col("v"), self.buckets)).distinct().collect()
            rows = rows.where(F.col("bucket").isin([r[0] for r in numbers]) & F.col("version_id").isin(version_ids))
        return rows.select(*self.schema.names)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.hint("rebalance", *KEYS).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        """Add rows, each as a new file of its partition."""
        self._write(rows.select(*self.schema.names).withColumn("bucket", bucket_of(F.col("version_id"), self.buckets)), "append")

    def replace(self, new: DataFrame, versions: DataFrame, pipeline_version: str) -> int:
        """Put new in place of all rows of these versions (version_id) under a pipeline version; the number of partitions rewritten."""
        gone = versions.select("version_id").distinct()
        rows = new.select(*self.schema.names).where(F.col("pipeline_version") == pipeline_version).withColumn("bucket", bucket_of(F.col("version_id"), self.buckets))
        # buckets at most
        touched = [r[0] for r in rows.select("bucket").union(gone.select(bucket_of(F.col("version_id"), self.buckets))).distinct().collect()]
        old = self._stored().where((F.col("pipeline_version") == pipeline_version) & F.col("bucket").isin(touched))
        state = written(old.join(gone, "version_id", "left_anti").select(*rows.columns).unionByName(rows), "partitions")
        left = {r[0] for r in state.select("bucket").distinct().collect()}
        self._write(state, "overwrite")
        for bucket in set(touched) - left:  # a partition without rows is not in the overwrite
            self._drop(pipeline_version, bucket)
        return len(touched)

    def _drop(self, pipeline_version: str, bucket: int) -> None:
        jvm = self.spark.sparkContext._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(pipeline_version)
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pipeline_version={name}/bucket={bucket}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
