"""Nearest neighbours by a block matrix join (operator 3).

Queries and candidates are cut into stripes; each pair of stripes is a tile of one task. A task holds its
queries and the best of each so far, and reads its candidates batch by batch, so its memory doesn't grow with
the table. Of a block of both, int8 codes are multiplied, and the error bound of each vector's code turns a
product into an interval that holds the cosine. Pairs whose upper end reaches the k-th best score so far and the
k-th best lower end of the block are computed again in double precision from the original vectors; heaps merge
the tiles' best. The result is exact.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do null ids.
Rows repeated with one id count once. Of equal vectors a block keeps the k + 1 smallest ids: no query,
itself possibly one of them, can use more. Vectors of another length than the query's are no
candidates. With fewer than k candidates all are returned. Ties go to the smaller id. Vectors are scaled
by powers of two before anything is squared, so very large and very small ones have their cosines, too.
Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import BATCH_ROWS, prepare, trim

#: Dimensions whose products of codes add up to whole numbers that float32 holds exactly (127 * 127 * 1024 < 2^24).
EXACT = 1024
#: Numbers of a tile's queries (2 k more for each, its best) and candidates.
QUERY_NUMBERS, CANDIDATE_NUMBERS = 1 << 21, 1 << 22
#: Rows and candidates that are multiplied at once, and numbers of the candidates, and of either side of pairs, that are doubles at once.
TILE_ROWS, TILE_COLUMNS, BLOCK_NUMBERS = 512, 2048, 1 << 19


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is between a half and one."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the scale of each, and the length of what the code misses."""
    scale = np.abs(v).max(axis=1) / 127
    codes = np.rint(v / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((v - codes * scale[:, None]) ** 2).sum(axis=1))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of scaled rows of doubles; equal rows always give equal numbers."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _unit_codes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _codes(v / np.sqrt((v**2).sum(axis=1))[:, None])


class Best:
    """The k best candidates so far of each query. Candidates are added by ascending id, any number at once."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k, self.last = k, None
        self.asks, first = np.unique(ids, return_index=True)
        self.vectors = scaled(vectors[first])
        self.codes, self.scale, self.miss = _unit_codes(self.vectors)
        self.ids = np.full((len(self.asks), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(self.asks), k), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        some = max(1, min(TILE_COLUMNS, BLOCK_NUMBERS // vectors.shape[1]))
        for at in range(0, len(ids), some):
            self._block(ids[at : at + some], np.ascontiguousarray(vectors[at : at + some], np.float64))

    def _block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        keep = np.concatenate([[self.last is None or ids[0] != self.last], ids[1:] != ids[:-1]])
        self.last = ids[-1]
        ids, vectors = ids[keep], vectors[keep]
        if not len(ids):
            return
        same = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        by = np.lexsort((ids, same))
        first = np.flatnonzero(np.concatenate([[True], same[by][1:] != same[by][:-1]]))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        kept = np.sort(by[place <= self.k])
        ids, vectors = ids[kept], scaled(vectors[kept])
        codes, scale, miss = _unit_codes(vectors)
        codes = codes.astype(np.float32)
        rounding = 1e-9 + (vectors.shape[1] + 16) * 2.0**-50  # of unit vectors and their products in doubles
        for at in range(0, len(self.asks), TILE_ROWS):
            own = slice(at, at + TILE_ROWS)
            asked = self.codes[own].astype(np.float32)
            near = np.zeros((len(asked), len(codes)))
            for d in range(0, codes.shape[1], EXACT):
                near += asked[:, d : d + EXACT] @ codes[:, d : d + EXACT].T
            near *= self.scale[own, None] * scale[None, :]
            error = self.miss[own, None] + (1 + self.miss[own, None]) * miss[None, :] + rounding
            place = np.searchsorted(ids, self.asks[own])
            self_at = np.flatnonzero(ids[np.minimum(place, len(ids) - 1)] == self.asks[own])
            near[self_at, place[self_at]] = -np.inf
            least = self.scores[own, -1]
            hits = near + error >= least[:, None]
            if np.count_nonzero(hits) > 4 * self.k * len(asked) and len(ids) >= self.k:  # the best so far leave out little
                low = near - error
                low.partition(len(ids) - self.k, axis=1)
                hits = near + error >= np.maximum(least, low[:, len(ids) - self.k])[:, None]
            hits[self_at, place[self_at]] = False
            self._merge(at, *np.nonzero(hits), ids, vectors)

    def _merge(self, at: int, rows: np.ndarray, cols: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Pairs of the queries from place at on (rows, ascending) and the candidates, computed exactly, go among the best."""
        if not len(rows):
            return
        scores, some = np.empty(len(rows)), max(1, BLOCK_NUMBERS // vectors.shape[1])
        for i in range(0, len(rows), some):
            scores[i : i + some] = _exact(self.vectors[at + rows[i : i + some]], vectors[cols[i : i + some]])
        asked = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(asked, self.k)])
        ids = np.concatenate([ids[cols], self.ids[at + asked].ravel()])
        scores = np.concatenate([scores, self.scores[at + asked].ravel()])
        by = np.lexsort((ids, -scores, rows))
        begin = np.searchsorted(rows[by], asked)
        by = by[np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by)))) < self.k]
        self.ids[at + asked], self.scores[at + asked] = ids[by].reshape(-1, self.k), scores[by].reshape(-1, self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, candidate, cosine; best first."""
        some = np.isfinite(self.scores)
        return np.repeat(self.asks, some.sum(axis=1)), self.ids[some], self.scores[some]


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k best candidates of each query in one tile: (query, candidate, cosine)."""
    best, order = Best(query_ids, queries, k), np.argsort(ids, kind="stable")
    best.add(ids[order], vectors[order])
    yield from zip(*(c.tolist() for c in best.found()), strict=True)


def nearest(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each row whose id is divisible by every."""
    prepare(df.sparkSession)
    given = df.select(vector).dtypes[0][1] in ("array<float>", "array<double>")
    v = F.col(vector) if given else F.col(vector).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(usable).withColumn("dim", F.size("v"))
    is_query = F.pmod("id", F.lit(every)) == 0
    numbers = F.coalesce(F.size(F.col(vector)), F.lit(0)).cast("long")
    total, all_numbers, query_numbers = df.select(F.count(F.lit(1)), F.coalesce(F.sum(numbers), F.lit(0)), F.coalesce(F.sum(F.when(F.pmod(F.col(vec_id).cast("long"), F.lit(every)) == 0, numbers + 2 * k)), F.lit(0))).first()
    down, across = max(1, -(-query_numbers // QUERY_NUMBERS)), max(1, -(-all_numbers // CANDIDATE_NUMBERS))
    # more tasks than tiles of full size, as long as tiles stay worth their copies
    spread = df.sparkSession.sparkContext.defaultParallelism
    across = max(across, min(spread, -(-total // 2048)))
    stripe = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    queries = rows.where(is_query).withColumn("q", F.lit(True)).withColumn("i", stripe(down)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    candidates = rows.withColumn("q", F.lit(False)).withColumn("j", stripe(across)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    names = [(F.col("i") * across + F.col("j")).cast("int").alias("tile"), "dim", "q", "id", "v"]
    tiles = queries.select(*names).unionByName(candidates.select(*names))
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by tile and length, queries first, then by id."""
        of, asks, best = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            found = [pa.array(c, t) for c, t in zip(best.found(), kinds.values(), strict=True)] if best else [()]
            for at in range(0, len(found[0]), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(at, BATCH_ROWS) for c in found], names=list(kinds))

        for batch in batches:
            part, dim, asking, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "dim", "q", "id"))
            vectors = batch.column("v")
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (dim[1:] != dim[:-1]) | (asking[1:] != asking[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if begin == end:
                    continue
                if of != (part[begin], dim[begin]):
                    yield from close()
                    of, asks, best = (part[begin], dim[begin]), [], None
                rows = ids[begin:end], vectors.slice(begin, end - begin).flatten().to_numpy(zero_copy_only=False).reshape(end - begin, -1)
                if asking[begin]:
                    asks.append((rows[0].copy(), rows[1].astype(np.float64)))
                    continue
                if asks:
                    best, asks = Best(*(np.concatenate(c) for c in zip(*asks, strict=True)), k), []
                if best:
                    best.add(*rows)
        yield from close()
        trim()

    dealt = tiles.repartitionById(down * across, "tile").sortWithinPartitions("tile", "dim", F.desc("q"), "id")
    best = dealt.mapInArrow(run, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by query; a heap holds the best of one."""
        query, heap, out = None, [], []

        def close() -> None:
            out.extend((query, rank, -i, score) for rank, (score, i) in enumerate(sorted(heap, reverse=True), 1))
            heap.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, i, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    close()
                    query = q
                heapq.heappush(heap, (score, -i))
                if len(heap) > k:
                    heapq.heappop(heap)
            if len(out) > 1 << 14:
                yield made()
        close()
        if out:
            yield made()

    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM ok)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.l * c.l) AS score
    FROM n q JOIN n c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)))
WHERE rank <= 5
"""
