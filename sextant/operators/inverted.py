"""Stored inverted index: postings by lexeme in blocks with upper bounds, and a top-n search that skips blocks.

Chunks are dealt to tasks by their id, so that each gets as much text, and within a task into segments of SEGMENT chunks of like
length. A row of the index is a block: what one lexeme has in one segment, with the most positions that any chunk of it has. A block's
positions are stored as one list, with the end of each chunk's part, and its chunks by their number in the segment; one more row of a
segment, with no lexeme, in the buckets below 0, has their ids. Blocks are stored by bucket of the lexeme and sorted in it, so a search
reads the buckets of its lexemes. All blocks of a segment together hold everything about its chunks, so a segment is
scored by itself, and its blocks say beforehand what a chunk in it can reach at most:

  every shortest cover ends at another position, so they are as many as the positions of the terms at most;
  where all terms are needed, each cover holds a position of the rarest one, and that position lies in as many covers as there are terms at most.

A search scores the segments that can reach most, then only those others whose bound isn't below the last score that
counts. The result is exact; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fts

#: Chunks of a segment, buckets of lexemes, and segments that are scored first; each round takes RATE times as many.
SEGMENT, BUCKETS, FIRST, RATE = 128, 64, 16, 8
#: Buckets of the ids.
ID_BUCKETS = 8


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


class InvertedIndex:
    """A table of blocks under a path: lexeme, segment, n, total (positions of all chunks), most, rows (numbers of the chunks), ends, places, by bucket; chunk_ids by segment."""

    def __init__(self, spark: SparkSession, path: str, language: str = "portuguese", buckets: int = BUCKETS, kind: T.DataType = T.StringType()):
        """kind: type of the chunks' ids."""
        self.spark, self.path, self.language, self.buckets, self.kind = spark, path.rstrip("/"), language, buckets, kind
        columns = [("lexeme", T.StringType()), ("segment", T.LongType()), ("n", T.IntegerType()), ("total", T.LongType()), ("most", T.IntegerType()), ("rows", T.ArrayType(T.IntegerType())), ("chunk_ids", T.ArrayType(kind)), ("ends", T.ArrayType(T.IntegerType())), ("places", T.ArrayType(T.IntegerType()))]
        self.schema = T.StructType([T.StructField(*c) for c in columns])

    @staticmethod
    def build(chunks: DataFrame, path: str, language: str = "portuguese", buckets: int = BUCKETS, segment: int = SEGMENT) -> InvertedIndex:
        """Index all chunks (chunk_id, text). Chunks meet those of like length, whose scores are alike, so that bounds tell segments apart."""
        spark = chunks.sparkSession
        index = InvertedIndex(spark, path, language, buckets, chunks.schema["chunk_id"].dataType)
        names = index.schema.names
        dealt = chunks.select("chunk_id", "text").repartition("chunk_id").sortWithinPartitions(F.octet_length("text").desc_nulls_last(), "chunk_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, count = TaskContext.get().partitionId() << 32, 0
            held: list[pa.RecordBatch] = []
            rows = 0

            def block_rows() -> Iterator[pa.RecordBatch]:
                nonlocal count
                table = pa.Table.from_batches(held).combine_chunks()
                own, what, place, lexemes = fts._placed(table.to_batches()[0], language)
                # by lexeme; rows and places are in order
                by = np.argsort(what.astype(np.min_scalar_type(len(lexemes))), kind="stable")
                own, what, place = own[by], what[by], place[by]
                posting = fts._changes(what, own)
                block = fts._changes(what[posting])
                size, chunks_of = np.diff(np.append(posting, len(own))), np.diff(np.append(block, len(posting)))
                most, total = (f.reduceat(size, block) if len(block) else np.zeros(0, np.int64) for f in (np.maximum, np.add))
                ends = np.cumsum(size) - np.repeat(posting[block], chunks_of)
                ids = fts._lists(np.zeros(1, np.int64), len(table), table.column("chunk_id").combine_chunks())
                ints = lambda a: pa.array(a.astype(np.int32))
                lists = [fts._lists(block, len(posting), ints(own[posting])), pa.nulls(len(block), ids.type), fts._lists(block, len(posting), ints(ends)), fts._lists(posting[block], len(own), ints(place))]
                columns = [lexemes.take(pa.array(what[posting][block])), pa.array(np.full(len(block), base + count)), ints(chunks_of), pa.array(total), ints(most), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                yield pa.RecordBatch.from_arrays([pa.array([base + count]) if x == "segment" else ids if x == "chunk_ids" else pa.nulls(1, c.type) for x, c in zip(names, columns, strict=True)], names=names)
                count += 1

            for batch in batches:
                while batch.num_rows:
                    take = batch.slice(0, segment - rows)
                    held.append(take)
                    rows += take.num_rows
                    batch = batch.slice(take.num_rows)
                    if rows == segment:
                        yield from block_rows()
                        held, rows = [], 0
            if rows:
                yield from block_rows()

        blocks = fts._lowered(dealt, "chunk_id", "text").mapInArrow(run, index.schema).withColumn("bucket", F.when(F.col("lexeme").isNull(), -1 - F.pmod("segment", F.lit(ID_BUCKETS)).cast("int")).otherwise(bucket_of(F.col("lexeme"), buckets)))
        # a bucket's blocks come together, in files of even size; sorted, so that row groups are skipped by lexeme and bound
        blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "lexeme", F.desc("most")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return index

    def _table(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def _ids(self) -> DataFrame:
        """segment, chunk_ids."""
        return self._table().where("bucket < 0").select("segment", "chunk_ids")

    def stored(self, terms: list[str] | None = None) -> DataFrame:
        """All blocks, with the positions of each chunk, or those of some lexemes: only their buckets are read."""
        before = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
        rows = self._table().drop("chunk_ids").withColumn("positions", F.transform("ends", lambda end, i: F.slice("places", before(i) + 1, end - before(i))))
        if terms is None:
            return rows.where("bucket >= 0")
        numbers = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets)).distinct().collect()] if terms else []
        return rows.where(F.col("bucket").isin(numbers) & F.col("lexeme").isin(*terms))

    def blocks(self, terms: list[str] | None = None) -> DataFrame:
        """The same with the chunks' ids."""
        found = self.stored(terms).join(self._ids().withColumnRenamed("chunk_ids", "all_ids"), "segment")
        return found.withColumn("chunk_ids", F.transform("rows", lambda r: F.get("all_ids", r))).drop("all_ids")

    def postings(self) -> DataFrame:
        """chunk_id, lexeme, positions: what fts.postings makes of the chunks."""
        each = F.explode(F.arrays_zip("chunk_ids", "positions")).alias("x")
        return self.blocks().select("lexeme", each).select("x.chunk_ids", "lexeme", "x.positions").toDF("chunk_id", "lexeme", "positions")

    def bounds(self, query: fts.Query) -> DataFrame:
        """segment, bound: what no chunk's score in it exceeds; segments that hold no match for want of a lexeme are left out."""
        terms = query.terms()
        per = self.stored(terms).groupBy("segment").agg(F.sum("most").alias("all"), F.min("most").alias("least"), F.count(F.lit(1)).alias("held"))
        if needs_all(query):
            return per.where(F.col("held") == len(terms)).select("segment", F.least("all", F.col("least") * len(terms)).alias("bound"))
        return per.select("segment", F.col("all").alias("bound"))

    def _scored(self, query: fts.Query, segments: DataFrame) -> DataFrame:
        """chunk_id and fts_score of the matches in some segments."""
        chosen = segments.select("segment")
        rows = self.stored(query.all_terms()).join(chosen, "segment", "left_semi")
        each = rows.select("segment", "lexeme", F.explode(F.arrays_zip("rows", "positions")).alias("x"))
        whole = each.groupBy("segment", F.col("x.rows").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("lexeme", F.col("x.positions").alias("positions")))).alias("places"))
        found = whole.where(fts.matches(query, F.col("places"))).select("segment", "row", fts.score(query).alias("fts_score"))
        ids = self._ids().join(chosen, "segment", "left_semi").select("segment", F.posexplode("chunk_ids").alias("row", "chunk_id"))
        return found.join(ids, ["segment", "row"]).select("chunk_id", "fts_score")

    def top(self, query: fts.Query | None, top: int, read: list | None = None) -> DataFrame:
        """chunk_id, fts_score, fts_rank: the same rows as fts.search. read: gets the number of segments scored and of all, round by round."""
        schema = T.StructType([T.StructField("chunk_id", self.kind), T.StructField("fts_score", T.DoubleType())])
        if query is not None and not query.needs_term():
            raise ValueError("a query that chunks without its terms match has no use for an index")
        best, bound, edge = [], None, None
        if query is not None:
            bound = self.bounds(query).persist()
            total, size = bound.count(), FIRST
            done = None
            while True:
                left = bound if done is None else bound.where(done)
                taken = left.orderBy(F.desc("bound"), "segment").limit(size).agg(F.min(F.struct("bound", -F.col("segment"))).alias("last"), F.count(F.lit(1)).alias("n")).first()
                if not taken["n"]:
                    break
                edge = taken["last"]
                # the segments of this round: from the last round's end down to the size-th bound
                here = left.where((F.col("bound") > edge[0]) | ((F.col("bound") == edge[0]) & (F.col("segment") <= -edge[1])))
                found = self._scored(query, here).orderBy(F.desc("fts_score"), "chunk_id").limit(top).collect()  # top rows at most
                best = sorted([*best, *map(tuple, found)], key=lambda r: (-r[1], r[0]))[:top]
                if read is not None:
                    read.append((taken["n"], total))
                # a segment whose bound is below the last score that counts can't change the result
                floor = best[-1][1] if len(best) == top else 0.0
                done = ((F.col("bound") < edge[0]) | ((F.col("bound") == edge[0]) & (F.col("segment") > -edge[1]))) & (F.col("bound") >= floor)
                size *= RATE
            bound.unpersist()
        out = self.spark.createDataFrame(best, schema)
        return out.selectExpr("chunk_id", "fts_score", "cast(row_number() OVER (ORDER BY fts_score DESC, chunk_id) AS int) AS fts_rank")


def needs_all(query: fts.Query) -> bool:
    """Whether a match holds every one of the query's terms."""
    return query.kind in ("term", "phrase") or (query.kind == "and" and all(needs_all(p) for p in query.parts if p.kind != "not"))
