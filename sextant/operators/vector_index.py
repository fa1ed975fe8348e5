"""Approximate nearest-neighbour search over an inverted file of cells.

Centroids are learnt by k-means with cosine distance on a bounded sample; every vector is stored under the cell of its
nearest centroid, a partition of the table each. A search ranks the centroids by their distance to the question and reads the
partitions of the nearest cells alone, as many as the search width asks for, so it reads probes / cells of the
vectors. Within them distances are exact. Widening the search to all cells gives the exact result. How many cells a search needs
depends on how well the vectors fall into cells: calibrated() measures it against the exact result for stored vectors as questions.

Vectors that are null, zero, or hold a null or non-finite component have no direction and are not stored; nor are vectors of
another dimension than the index. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells at most (half the root of the number of vectors, unless given; their centroids are broadcast: 16384 of 1024 numbers are 128 MB at most), and vectors sampled to learn a cell from.
MOST_CELLS, SAMPLE_A_CELL = 16384, 256
#: Cells that a search of width 40 reads unless it was calibrated; wider searches read more in proportion.
WIDTH, WIDTH_CELLS = 40, 4
#: Stored vectors that a calibration asks with, and what it adds to the recall that is wanted, as it measures on some questions only.
CALIBRATION, MARGIN = 512, 0.02
#: Questions and rows that are multiplied at once.
TILE_QUESTIONS, TILE_ROWS = 512, 16384


def has_direction(vector: Column) -> Column:
    """Whether a vector is there, whole, finite and not zero."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # else very small and very large numbers leave the range when squared
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class VectorIndex:
    """Tables under a path: centroids (cell, centroid) and vectors (chunk_id, embedding, by cell)."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        """kind: type of the chunks' ids."""
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # MOST_CELLS at most
        self.centroids = np.array([r["centroid"] for r in rows], float).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)

    @staticmethod
    def build(rows: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> VectorIndex:
        """Learn the cells from a sample of rows (chunk_id, embedding) and store every row."""
        spark, path, kind = rows.sparkSession, path.rstrip("/"), rows.schema["chunk_id"].dataType.simpleString()
        usable = rows.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where(has_direction(F.col("embedding")))
        by_size = usable.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()  # a row a dimension
        if by_size is None:
            spark.createDataFrame([], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
            usable.withColumn("cell", F.lit(0)).write.partitionBy("cell").parquet(f"{path}/vectors")
            return VectorIndex(spark, path, kind)
        dim, n = by_size
        usable = usable.where(F.size("embedding") == dim)
        cells = min(max(2, cells or round(n**0.5 / 2)), MOST_CELLS)
        share = min(1.0, cells * SAMPLE_A_CELL / n)
        sample = usable.where(F.abs(F.xxhash64("chunk_id", F.lit(seed)) % 1_000_000) < share * 1_000_000) if share < 1 else usable
        largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
        points = sample.select(array_to_vector(F.transform("embedding", lambda x: x / largest)).alias("features"))
        model = KMeans(k=cells, distanceMeasure="cosine", seed=seed, maxIter=10, initSteps=2).fit(points)
        centers = [c / max(np.sqrt((c * c).sum()), 1e-300) for c in model.clusterCenters()]
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        index = VectorIndex(spark, path, kind)
        index.add(usable)
        return index

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def add(self, rows: DataFrame) -> None:
        """Store more rows under the cells that were learnt."""
        dim, shared = self.centroids.shape[1], self.spark.sparkContext.broadcast(self.centroids)
        usable = rows.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding")).where(has_direction(F.col("embedding")) & (F.size("embedding") == dim))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argmax(_unit(matrix(batch.column("embedding"), dim)) @ shared.value.T, axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["chunk_id", "embedding", "cell"])

        placed = usable.mapInArrow(run, f"chunk_id {self.kind}, embedding array<double>, cell int")
        # rows of a cell come together in files of even size, also those of a cell that holds a third of all
        placed.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"chunk_id {self.kind}, embedding array<double>, cell int").parquet(f"{self.path}/vectors")

    def probes(self, width: int) -> int:
        """Cells that a search of this width reads."""
        return max(1, min(self.cells, -(-width * WIDTH_CELLS // WIDTH)))

    def calibrated(self, recall: float = 0.9, top: int = 10) -> int:
        """The least width of which the top nearest of stored vectors are found in this share, measured on CALIBRATION of them."""
        from .many import vector_top_many

        if not self.cells:
            return WIDTH
        stored = self.vectors()
        asked = stored.orderBy(F.xxhash64("chunk_id", F.lit(11)), "chunk_id").limit(CALIBRATION).select(F.col("chunk_id").alias("query_id"), "embedding")
        exact = vector_top_many(stored, asked, top).join(stored.select("chunk_id", "cell"), "chunk_id")
        asked_rows = {r["query_id"]: r["embedding"] for r in asked.collect()}  # CALIBRATION rows, and top times as many below
        ids = list(asked_rows)
        order = self.near_cells(np.array([asked_rows[i] for i in ids]), self.cells)
        place = {i: {int(c): k for k, c in enumerate(cells)} for i, cells in zip(ids, order, strict=True)}
        needed = np.sort([place[r["query_id"]][r["cell"]] + 1 for r in exact.select("query_id", "cell").collect()])
        probes = int(needed[min(len(needed) - 1, int(np.ceil(min(1.0, recall + MARGIN) * len(needed))) - 1)])
        return -(-probes * WIDTH // WIDTH_CELLS)

    def near_cells(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each row, nearest first."""
        return np.argsort(-(_unit(queries) @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def candidates(self, query: list[float], width: int = WIDTH) -> DataFrame:
        """chunk_id and embedding in the cells that a search reads."""
        query = np.asarray(query, float)[None, :]
        if not self.cells or query.shape[1] != self.centroids.shape[1] or not np.isfinite(query).all() or not query.any():
            return self.vectors().select("chunk_id", "embedding").where("false")
        return self.vectors().where(F.col("cell").isin(self.near_cells(query, self.probes(width))[0].tolist())).select("chunk_id", "embedding")

    def search_many(self, questions: DataFrame, top: int, width: int = WIDTH) -> DataFrame:
        """query_id, chunk_id, vec_distance, vec_rank: the top found of each question (query_id, embedding).

        Each question is sent to the cells that it reads; a cell's questions and a piece of its vectors meet in one task.
        """
        dim, probes, shared = self.centroids.shape[1] if self.cells else 0, self.probes(width), self.spark.sparkContext.broadcast(self.centroids)
        kinds = questions.schema["query_id"].dataType.simpleString(), self.kind
        asked = questions.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where(has_direction(F.col("embedding")) & (F.size("embedding") == dim))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = _unit(matrix(batch.column("embedding"), dim))
                    cells = np.argsort(-(unit @ shared.value.T), axis=1, kind="stable")[:, :probes]
                    again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1])))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cells.ravel().astype(np.int32))], names=["query_id", "embedding", "cell"])

        sent = asked.mapInArrow(route, f"query_id {kinds[0]}, embedding array<double>, cell int")
        # a cell of many rows is dealt to several tasks, each with all of the cell's questions
        most = self.vectors().groupBy("cell").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        pieces = max(1, -(-most // TILE_ROWS))
        left = sent.select("query_id", F.col("embedding").alias("v"), "cell", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"))
        right = self.vectors().select("chunk_id", F.col("embedding").alias("v"), "cell", F.pmod(F.xxhash64("chunk_id"), F.lit(pieces)).cast("int").alias("piece"))
        found = left.groupBy("cell", "piece").cogroup(right.groupBy("cell", "piece")).applyInPandas(tile_top(top), f"query_id {kinds[0]}, chunk_id {kinds[1]}, vec_distance double")
        return ranked(found, "vec_distance, chunk_id", "vec_rank", top)


def tile_top(top: int, digits: int = 9):
    """Of a tile's questions (query_id, v) and rows (chunk_id, v): the nearest top of each question."""

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "vec_distance": []})
        b = b.sort_values("chunk_id", kind="stable")
        candidates = _unit(np.stack(b["v"].to_numpy())).T
        parts = []
        for at in range(0, len(a), TILE_QUESTIONS):  # bounds the matrix of distances
            some = a.iloc[at : at + TILE_QUESTIONS]
            far = np.round(1.0 - _unit(np.stack(some["v"].to_numpy())) @ candidates, digits) + 0.0  # no negative zeros
            best = np.argsort(far, axis=1, kind="stable")[:, :top]
            parts.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), best.shape[1]), "chunk_id": b["chunk_id"].to_numpy()[best.ravel()], "vec_distance": np.take_along_axis(far, best, 1).ravel()}))
        return pd.concat(parts)

    return tile


def ranked(scored: DataFrame, order: str, rank: str, top: int) -> DataFrame:
    """The first top rows of each question, numbered; only that many of a question leave each task."""
    return scored.selectExpr("*", f"cast(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS int) AS {rank}").where(F.col(rank) <= top)
