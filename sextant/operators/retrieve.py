"""Hybrid retrieval: full-text and vector candidates, reciprocal rank fusion, late enrichment.

Each signal is cut to its top rows before ranks are numbered, so no branch sorts all hits in one task;
the fused side has at most n1 + n2 rows, a bound that is passed on as a broadcast hint.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fts
from ..functions.embed import Provider, embed
from ..functions.text import search_keywords


@dataclass(frozen=True)
class Params:
    n1_fts: int = 30
    n2_vec: int = 30
    rrf_k: int = 60
    top_k: int = 5

    def check(self) -> None:
        if self.n1_fts <= 0 and self.n2_vec <= 0:
            raise ValueError("at least one of n1_fts and n2_vec must be positive")
        if self.top_k < 1 or self.rrf_k < 0:
            raise ValueError("top_k must be at least 1 and rrf_k at least 0")


CLI_QUERY = Params(50, 10, 60, 12)
CLI_ASK = Params(50, 0, 60, 12)
API_QUERY = Params()
API_ASK = Params(30, 0, 60, 5)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """In double precision; null for a zero vector or another length."""
    v = vector.cast("array<double>")
    q = F.array(*(F.lit(float(x)) for x in query))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    norm = F.sqrt(total(F.transform(v, lambda x: x * x)))
    length = sum(x * x for x in query) ** 0.5
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    return F.when((F.size(v) == len(query)) & (norm > 0), 1.0 - dot / (norm * length)) if length else F.lit(None).cast("double")


def vector_top(rows: DataFrame, query: list[float], top: int, digits: int | None = None) -> DataFrame:
    """chunk_id, vec_distance, vec_rank of the nearest; rows: chunk_id, embedding; ties go to the smaller id."""
    distance = cosine_distance(F.col("embedding"), query)
    distance = F.round(distance, digits) if digits is not None else distance
    near = rows.select("chunk_id", distance.alias("vec_distance")).where("vec_distance IS NOT NULL").orderBy("vec_distance", "chunk_id").limit(top)
    return near.selectExpr("chunk_id", "vec_distance", "cast(row_number() OVER (ORDER BY vec_distance, chunk_id) AS int) AS vec_rank")


def fuse(text: DataFrame | None, vectors: DataFrame | None, rrf_k: int, top_k: int, digits: int | None = None) -> DataFrame:
    """chunk_id, rrf_score, both ranks and scores of the best; an absent signal is typed nulls."""
    if text is None and vectors is None:
        raise ValueError("no signal to fuse")
    if text is None or vectors is None:
        both = (vectors if text is None else text).select("*", *(F.lit(None).cast(k).alias(c) for c, k in ((("fts_score", "double"), ("fts_rank", "int")) if text is None else (("vec_distance", "double"), ("vec_rank", "int")))))
    else:
        both = text.join(vectors, "chunk_id", "full_outer")  # n1 and n2 rows at most
    part = lambda c: F.when(F.col(c).isNotNull(), F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(c))).otherwise(0.0)
    score = part("fts_rank") + part("vec_rank")
    score = F.round(score, digits) if digits is not None else score
    return both.select("chunk_id", score.alias("rrf_score"), "fts_rank", "fts_score", "vec_rank", "vec_distance").orderBy(F.desc("rrf_score"), "chunk_id").limit(top_k)


def indexed_chunks(chunks: DataFrame, versions: DataFrame, pipeline_version: str | None = None, version_id: str | None = None) -> DataFrame:
    """Chunks of indexed versions; absent parameters leave no predicate behind."""
    good = versions.where("status = 'INDEXED'").select("version_id")
    for column, value in (("pipeline_version", pipeline_version), ("version_id", version_id)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    return chunks.join(good, "version_id", "left_semi")


def fts_debug(chunks: DataFrame, text: str, looked_for: str, top: int = 10, shown: int = 140, stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """chunk_id, rank, found and preview of the chunks that hold all words of text: whether the one that is looked for is among them."""
    query = fts.plain(text, language=language)
    rows = fts.found_places(chunks, query.all_terms() if query else [], False, stored, language)
    own = F.array(*(F.element_at("places", F.lit(t)) for t in (query.terms() if query else [])))
    hits = rows.where(fts.matches(query, F.col("places")) if query else F.lit(False)).select("chunk_id", F.round(fts.plain_rank(own, True), 9).alias("rank"))
    best = hits.orderBy(F.desc("rank"), "chunk_id").limit(top)
    return chunks.join(F.broadcast(best), "chunk_id").select("chunk_id", "rank", F.col("text").ilike(f"%{looked_for}%").alias("found"), F.left("text", F.lit(shown)).alias("preview"))  # top rows


def forms(question: str, fold: bool = True, language: str = "portuguese") -> list[tuple[str, fts.Query | None]]:
    """The query forms of a question, in the order in which they are tried."""
    words = search_keywords(question)
    return [("websearch", fts.websearch(question, fold, language)), ("plain", fts.plain(words, fold, language)), ("or", fts.any_of(words, fold, language))]


def hits(chunks: DataFrame, queries: list[tuple[str, fts.Query | None]], stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """One row: how many chunks each named query matches, in one pass; 0 where there is no query."""
    live = [q for _, q in queries if q is not None]
    if not live:
        return chunks.sparkSession.range(1).select(*(F.lit(0).cast("long").alias(name) for name, _ in queries))
    terms = list(dict.fromkeys(t for q in live for t in q.all_terms()))
    rows = fts.found_places(chunks, terms, not all(q.needs_term() for q in live), stored, language)
    return rows.agg(*((F.count_if(fts.matches(q, F.col("places"))) if q is not None else F.lit(0).cast("long")).alias(name) for name, q in queries))


def fts_hits(chunks: DataFrame, form: str, text: str, stored: DataFrame | None = None, language: str = "portuguese") -> int:
    """How many chunks a text matches under one form; an empty text matches none."""
    if form not in fts.PARSERS:
        raise ValueError(f"no query form {form!r}")
    return hits(chunks, [("n", fts.PARSERS[form](text, language=language))], stored, language).first()["n"]


def ladder(chunks: DataFrame, question: str, fold: bool = True, stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """One row: how many chunks each form of a question matches, and mode, the first form with a hit (websearch if none has)."""
    tries = forms(question, fold, language)
    mode = F.coalesce(*(F.when(F.col(name) > 0, name) for name, _ in tries), F.lit(tries[0][0]))
    return hits(chunks, tries, stored, language).withColumn("mode", mode)


def hybrid(chunks: DataFrame, embeddings: DataFrame | None, question: str, vector: list[float] | None, params: Params = API_QUERY, model: str | None = None, fold: bool = True, pipeline_version: str | None = None, provider: Provider | None = None, stored: DataFrame | None = None, language: str = "portuguese") -> DataFrame:
    """The fused best of chunks (see indexed_chunks); embeddings: chunk_id, embedding, embedding_model_id, pipeline_version.

    provider embeds the question where a vector is needed and none is given; stored: postings.
    """
    params.check()
    text = vectors = None
    if params.n1_fts > 0:
        # the first of websearch(question), plain(keywords), or(keywords) with a hit, in one pass
        text = fts.search_first(chunks, [q for _, q in forms(question, fold, language)], params.n1_fts, stored, language).drop("form")
    if params.n2_vec > 0:
        if vector is None and provider is not None:
            vector = embed([question], provider, "query")[0]
        if vector is None or embeddings is None:
            raise RuntimeError("vector search needs a query vector")
        for column, value in (("embedding_model_id", model), ("pipeline_version", pipeline_version)):
            if value is not None:
                embeddings = embeddings.where(F.col(column) == value)
        keys = [c for c in ("chunk_id", "pipeline_version") if c in embeddings.columns and c in chunks.columns]  # a chunk's own vector
        vectors = vector_top(embeddings.join(chunks.select(keys), keys, "left_semi").select("chunk_id", "embedding"), vector, params.n2_vec)
    return fuse(text, vectors, params.rrf_k, params.top_k)


def enriched(scored: DataFrame, chunks: DataFrame, versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Scores with the chunk's text and its document nested; scored has at most top_k rows and is broadcast."""
    version = versions.select("version_id", "document_id", "source_url", "final_url", "captured_at")
    out = chunks.join(F.broadcast(scored), "chunk_id").join(version, "version_id").join(documents.select("document_id", "title", "source_org", "doc_type"), "document_id")
    document = F.struct("document_id", "title", "source_org", "doc_type", "source_url", "final_url", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("captured_at")).alias("document")
    ranked = out.select("chunk_id", "rrf_score", "fts_rank", "fts_score", "vec_rank", "vec_distance", "version_id", "pipeline_version", "chunk_index", "tokens_count", "text", "node_refs", document)
    return ranked.selectExpr("cast(row_number() OVER (ORDER BY rrf_score DESC, chunk_id) AS int) AS rank", "*")
