"""Queries of the search structures: the stored inverted index, the vector index, many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fts
from ..functions.text import ACT_TYPES, DOMAIN_TERMS, STOP_SEARCH, TOKEN
from ..operators.inverted import InvertedIndex
from ..operators.many import hybrid_many, vector_top_many
from ..operators.retrieve import Params
from ..operators.vector_index import VectorIndex
from ..scratch import new_path
from .queries import _ALL, _sql_fts, _texts, _vectors, LANGUAGE, N1, query, sql_tokens, table

RECALL, NEAR = 0.9, 10


def _index(spark: SparkSession, d: str) -> InvertedIndex:
    return InvertedIndex.build(_texts(spark, d), new_path(spark, "inverted"), LANGUAGE)


@query("WITH " + _sql_fts(_ALL, ["that", "with", "from"], "h0 OR h1 OR h2", N1) + "SELECT * FROM fts")
def inverted_or(spark, d):
    """Any of three words over stored blocks; segments that can't reach the last place are skipped."""
    return _index(spark, d).top(fts.any_of("that with from", language=LANGUAGE), N1)


@query("WITH " + _sql_fts(_ALL, ["of", "the", "with"], "ph AND h2 AND NOT h3", N1, ("from",), ("of", "the", 1)) + "SELECT * FROM fts")
def inverted_phrase(spark, d):
    """A phrase, a word, and a word that must not be there, over stored blocks."""
    return _index(spark, d).top(fts.websearch('"of the" with -from', language=LANGUAGE), N1)


@query(
    f"""SELECT lexeme, count(DISTINCT doc_id)::BIGINT AS n_chunks, count(*)::BIGINT AS n_places FROM (SELECT doc_id, unnest({sql_tokens("text")}) AS lexeme FROM documents)
WHERE lexeme NOT IN ({", ".join(f"'{w}'" for w in sorted(fts.STOP))}) GROUP BY lexeme"""
)
def inverted_stats(spark, d):
    """What the stored blocks hold, summed by lexeme."""
    return _index(spark, d).stored().groupBy("lexeme").agg(F.sum("n").alias("n_chunks"), F.sum("total").alias("n_places"))


def _every_hundredth(spark: SparkSession, d: str) -> DataFrame:
    """The stated questions of a vector search: rows whose id is divisible by 100."""
    return _vectors(spark, d).where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@query(
    """SELECT query_id, chunk_id, vec_distance, rank::INT AS vec_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_distance, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) + 0.0::DOUBLE AS vec_distance
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""
)
def vec_many(spark, d):
    """The exact nearest vectors of many questions, tile by tile."""
    return vector_top_many(_vectors(spark, d), _every_hundredth(spark, d), NEAR)


@query(f"SELECT count(*)::BIGINT AS n_questions, {NEAR} AS top, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vec_index_recall(spark, d):
    """Whether the vector index, at its calibrated width, finds the share of the exact nearest that it must."""
    vectors, asked = _vectors(spark, d), _every_hundredth(spark, d)
    index = VectorIndex.build(vectors, new_path(spark, "cells"))
    found = index.search_many(asked, NEAR, index.calibrated(RECALL, NEAR)).select("query_id", "chunk_id", F.lit(True).alias("hit"))
    rows = vector_top_many(vectors, asked, NEAR).join(found, ["query_id", "chunk_id"], "left")
    return rows.agg(F.countDistinct("query_id").alias("n_questions"), F.lit(NEAR).alias("top"), (F.count("hit") >= RECALL * F.count(F.lit(1))).alias("reached"))


@query("SELECT vec_id AS query_id, 0.0::DOUBLE AS vec_distance FROM embeddings WHERE vec_id % 100 = 0")
def vec_index_self(spark, d):
    """Each question is stored itself, so its own cell holds it: the narrowest search finds it at no distance."""
    index = VectorIndex.build(_vectors(spark, d), new_path(spark, "cells"))
    return index.search_many(_every_hundredth(spark, d), 1, 1).select("query_id", F.abs("vec_distance").alias("vec_distance"))


_TERMS = 24  # more words than that no document of the test tables holds together with a turn
_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_SEARCH))
_TYPES = ", ".join(f"'{w}'" for w in sorted(ACT_TYPES))
_LAST = ", ".join(f"max(CASE WHEN i = {i} THEN p END) OVER (PARTITION BY query_id, s, chunk_id ORDER BY p) AS l{i}" for i in range(_TERMS))
_LACKS = " + ".join(f"(l{i} IS NOT NULL)::INT" for i in range(_TERMS))


@query(
    f"""WITH ask AS (SELECT conv_id || '-' || turn AS query_id, text, conv_id FROM conversations WHERE conv_id % 100 = 0 AND role = 'user'),
kt AS (SELECT query_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{TOKEN}') AS t FROM ask),
kk AS (SELECT query_id, list_filter(t, lambda x, i: NOT (list_contains([{_TYPES}], x) AND i < len(t) AND regexp_full_match(coalesce(t[i + 1], ''), '[0-9]+'))
  AND NOT (regexp_full_match(x, '[0-9]+') AND i > 1 AND list_contains([{_TYPES}], coalesce(t[i - 1], ''))) AND NOT list_contains([{_STOPS}], x)
  AND CASE WHEN regexp_full_match(x, '[0-9]+') THEN len(x) <= 2 ELSE len(x) >= 3 END) AS l FROM kt),
kn AS (SELECT query_id, unnest(l) AS w, unnest(range(len(l))) AS nr FROM kk),
kd AS (SELECT query_id, w, coalesce(list_position([{", ".join(f"'{w}'" for w in DOMAIN_TERMS)}], w), 100) AS ahead, min(nr) AS nr FROM kn GROUP BY query_id, w),
k8 AS (SELECT query_id, string_agg(w, ' ' ORDER BY ahead, nr) AS text FROM (SELECT * FROM kd QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ahead, nr) <= 8) GROUP BY query_id),
tm AS (SELECT DISTINCT query_id, s, w FROM (SELECT query_id, 0 AS s, unnest({sql_tokens("text")}) AS w FROM ask UNION ALL SELECT query_id, 1, unnest({sql_tokens("text")}) FROM k8)
  WHERE w NOT IN ({", ".join(f"'{w}'" for w in sorted(fts.STOP))})),
ti AS (SELECT query_id, s, w, row_number() OVER (PARTITION BY query_id, s ORDER BY w) - 1 AS i, count(*) OVER (PARTITION BY query_id, s) AS n FROM tm),
tok AS (SELECT chunk_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS p FROM (SELECT doc_id::VARCHAR AS chunk_id, {sql_tokens("text")} AS t FROM documents)),
pl AS (SELECT query_id, s, i, n, chunk_id, p FROM tok JOIN ti USING (w)),
hs AS (SELECT query_id, s, chunk_id, any_value(n) AS n, count(DISTINCT i) AS k FROM pl GROUP BY ALL),
hit AS (SELECT query_id, s, chunk_id, k, CASE WHEN s = 0 THEN 0 WHEN k = n THEN 1 ELSE 2 END AS form FROM hs WHERE s = 1 OR (k = n AND n <= {_TERMS})),
ls AS (SELECT query_id, s, chunk_id, p, least({", ".join(f"l{i}" for i in range(_TERMS))}) AS b, {_LACKS} AS seen FROM (SELECT query_id, s, chunk_id, p, {_LAST} FROM pl SEMI JOIN hit USING (query_id, s, chunk_id))),
cv AS (SELECT query_id, s, chunk_id, b, min(p) AS e, any_value(k) AS k, any_value(form) AS form FROM ls JOIN hit USING (query_id, s, chunk_id) WHERE seen = k GROUP BY ALL),
sc AS (SELECT query_id, form, chunk_id, round(sum(1.0::DOUBLE / (1 + greatest(0, e - b + 1 - k))), 9) AS fts_score FROM cv GROUP BY query_id, form, chunk_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY form, fts_score DESC, chunk_id)::INT AS fts_rank, min(form) OVER (PARTITION BY query_id) AS taken FROM sc),
fx AS (SELECT query_id, chunk_id, fts_score, fts_rank FROM fr WHERE form = taken AND fts_rank <= 30),
vd AS (SELECT query_id, c.vec_id::VARCHAR AS chunk_id, round(list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) + 0.0::DOUBLE AS vec_distance FROM ask JOIN embeddings q ON q.vec_id = ask.conv_id, embeddings c),
vx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_distance, chunk_id)::INT AS vec_rank FROM vd) WHERE vec_rank <= 30)
SELECT * FROM (SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0), 12) AS rrf_score, fts_rank, fts_score, vec_rank, vec_distance,
 row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0), 12) DESC, chunk_id)::INT AS rank
 FROM fx FULL OUTER JOIN vx USING (query_id, chunk_id)) WHERE rank <= 12"""
)
def rrf_many(spark, d):
    """Hybrid search for many questions in one plan: the user turns of every hundredth conversation against all texts and vectors."""
    vectors = _vectors(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    return hybrid_many(None, vectors, turn_questions(spark, d, 100), Params(30, 30, 60, 12), LANGUAGE, _texts(spark, d))


def turn_questions(spark: SparkSession, d: str, every: int) -> DataFrame:
    """query_id, question, embedding: user turns, each with the vector of its conversation's number."""
    turns = table(spark, d, "conversations").where((F.col("conv_id") % every == 0) & (F.col("role") == "user"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return turns.join(vectors, "conv_id", "left").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("question"), "embedding")
