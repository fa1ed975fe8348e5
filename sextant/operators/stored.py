"""The searchable tables on disk, indexed version by version: chunks, their vectors and their postings.

All three are partitioned by pipeline version and version bucket, so indexing or reindexing some versions rewrites the
partitions of these alone. Vectors are kept by content too: a text that any chunk had under the same model is not embedded again.
The versions' state is changed last by the caller (lifecycle.mark_indexed), so a run that broke off is done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fts
from ..functions.embed import embedded_once
from ..schemas import TABLES
from ..scratch import written
from .chunk import Sizes
from .lifecycle import index_versions
from .partitioned import BUCKETS, PartitionedTable

VECTORS = T.StructType([T.StructField("version_id", T.StringType()), T.StructField("content_hash", T.StringType()), *TABLES["chunk_embeddings"].fields])
POSTINGS = T.StructType([T.StructField(n, T.StringType()) for n in ("version_id", "pipeline_version", "chunk_id", "lexeme")] + [T.StructField("positions", T.ArrayType(T.IntegerType()))])


class StoredIndex:
    """chunks, vectors and postings under a path."""

    def __init__(self, spark: SparkSession, path: str, language: str = "portuguese", buckets: int = BUCKETS):
        self.language = language
        self.chunks = PartitionedTable(spark, f"{path}/chunks", TABLES["embedding_chunks"], buckets)
        self.vectors = PartitionedTable(spark, f"{path}/vectors", VECTORS, buckets)
        self.postings = PartitionedTable(spark, f"{path}/postings", POSTINGS, buckets)

    def known(self) -> DataFrame:
        """One vector of each content and model."""
        return self.vectors.read().groupBy("content_hash", "embedding_model_id").agg(F.any_value("embedding").alias("embedding"))

    def index(self, versions: DataFrame, nodes: DataFrame, pipeline_version: str, model_id: str, make: Callable, now: str, sizes: Sizes = Sizes(), version_ids: list[str] | DataFrame | None = None, force: bool = False) -> DataFrame:
        """Chunk, embed and post the versions that wait for it (with force also indexed ones), in place of what they had
        under this pipeline; the versions done. A version without nodes is left waiting, with what it had."""
        stamp = F.lit(now).cast("timestamp")
        new = written(index_versions(versions, nodes, pipeline_version, sizes, version_ids, force).withColumn("created_at", stamp), "chunks")
        done = new.select("version_id").distinct()
        with_vectors, _ = embedded_once(new.select("chunk_id", "version_id", "pipeline_version", "text", "created_at"), self.known(), make, model_id)
        posts = fts.postings(new, language=self.language).join(new.select("chunk_id", "version_id", "pipeline_version"), "chunk_id")
        self.postings.replace(posts, done, pipeline_version)
        self.vectors.replace(with_vectors.withColumn("content_hash", F.sha2("text", 256)), done, pipeline_version)
        self.chunks.replace(new, done, pipeline_version)
        return done
