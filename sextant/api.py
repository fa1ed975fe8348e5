"""The question interface: query gives evidence, ask adds an extractive answer; both leave an audit row."""

from __future__ import annotations

import datetime
import json
import warnings
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.embed import Provider
from .operators.answer import extractive_answer
from .operators.lifecycle import audit_row, new_run_id
from .operators.retrieve import API_ASK, API_QUERY, Params, enriched, hybrid, indexed_chunks

SCHEMA_VERSION = 1


@dataclass
class KnowledgeBase:
    """Tables of schemas.TABLES; postings (fts.postings of the chunks) spare a search the texts."""

    documents: DataFrame
    versions: DataFrame
    chunks: DataFrame
    embeddings: DataFrame | None = None
    audit_path: str | None = None
    postings: DataFrame | None = None
    provider: Provider | None = None
    language: str = "portuguese"

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession


@dataclass(frozen=True)
class Filters:
    version_id: str | None = None
    pipeline_version: str | None = None
    embedding_model_id: str | None = None


class Unauthorized(Exception):
    """A wrong key; without a configured key the interface is open."""


def health(pipeline_version: str | None = None) -> dict:
    return {"ok": True, "service": "sextant", "pipeline_version": pipeline_version}


def call(function, kb: KnowledgeBase, request: dict, request_id: str | None = None, key: str | None = None, configured_key: str | None = None) -> tuple[str, dict]:
    """The request id (a new one if none is given) and the result of query or ask for a request's fields."""
    if configured_key and key != configured_key:
        raise Unauthorized("invalid key")
    defaults = API_ASK if function is ask else API_QUERY
    params = Params(**{f: request.get(f, v) for f, v in asdict(defaults).items()})
    result = function(kb, request.get("question", ""), request.get("vector"), params, request.get("pipeline_version"), request.get("version_id"), request.get("embedding_model_id"))
    return request_id or new_run_id(), result


def evidence(kb: KnowledgeBase, question: str, vector: list[float] | None, params: Params, filters: Filters) -> DataFrame:
    """The best chunks with rank, scores, text and document."""
    if not (question or "").strip():
        raise ValueError("the question is empty")
    params.check()
    chunks = indexed_chunks(kb.chunks, kb.versions, filters.pipeline_version, filters.version_id)
    best = hybrid(chunks, kb.embeddings, question, vector, params, filters.embedding_model_id, pipeline_version=filters.pipeline_version, provider=kb.provider, stored=kb.postings, language=kb.language)
    return enriched(best, chunks, kb.versions, kb.documents)


def _rows(found: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) | {"node_refs": [n.asDict() for n in r["node_refs"] or ()]} for r in found.orderBy("rank").collect()]  # top_k rows


#: What the contract asks of a result and its parts.
REQUIRED = ("schema_version", "run_type", "query", "retrieval", "generated_at", "results")
RETRIEVAL = ("version_id", "pipeline_version", "embedding_model_id", "n1_fts", "n2_vec", "rrf_k", "top_k")
SCORES = ("rrf_score", "fts_rank", "fts_score", "vec_rank", "vec_distance")
CHUNK = ("chunk_id", "version_id", "chunk_index", "tokens_count", "text")
RESULT = ("rank", "scores", "chunk", "document", "citations")


def _result(kind: str, question: str, params: Params, filters: Filters, now: str | None) -> dict:
    own = {"filters": asdict(filters), "params": asdict(params), "retrieval": {k: (asdict(filters) | asdict(params))[k] for k in RETRIEVAL}}
    return {"schema_version": SCHEMA_VERSION, "run_type": kind, "run_id": new_run_id(), "query": question, **own, "generated_at": now or datetime.datetime.now(datetime.timezone.utc).isoformat()}


def shaped(row: dict) -> dict:
    """A row of evidence as the contract has it: scores (also beside, as of old), chunk, document, citations."""
    scores = {k: row[k] for k in SCORES}
    return {"rank": row["rank"], **scores, "scores": scores, "chunk": {k: row[k] for k in CHUNK}, "document": row["document"], "citations": row["node_refs"]}


def _audited(kb: KnowledgeBase, result: dict, filters: Filters, strict: bool) -> dict:
    """Leave an audit row. That of a query must be written; an answer isn't lost because its record is."""
    if kb.audit_path:
        try:
            audit_row(kb.spark, result, result["generated_at"], filters.embedding_model_id or "", filters.pipeline_version or "").write.mode("append").parquet(kb.audit_path)
        except Exception as e:
            if strict:
                raise
            warnings.warn(f"no audit row: {e}", stacklevel=3)
    return result


def query(kb: KnowledgeBase, question: str, vector: list[float] | None = None, params: Params = API_QUERY, pipeline_version: str | None = None, version_id: str | None = None, model: str | None = None, now: str | None = None) -> dict:
    """Evidence as the JSON contract has it."""
    filters = Filters(version_id, pipeline_version, model)
    rows = _rows(evidence(kb, question, vector, params, filters))
    return _audited(kb, _result("query_rag", question, params, filters, now) | {"results": [shaped(r) for r in rows]}, filters, True)


def ask(kb: KnowledgeBase, question: str, vector: list[float] | None = None, params: Params = API_ASK, pipeline_version: str | None = None, version_id: str | None = None, model: str | None = None, now: str | None = None) -> dict:
    """Evidence with the snippet that answers best and the source it cites."""
    filters = Filters(version_id, pipeline_version, model)
    rows = [r | {"sid": f"S{r['rank']}"} for r in _rows(evidence(kb, question, vector, params, filters))]
    text, cited = extractive_answer(question, rows)
    sources = [shaped(r) | {"sid": r["sid"], "text": r["text"], "chunk_id": r["chunk_id"]} for r in rows]
    return _audited(kb, _result("ask_rag", question, params, filters, now) | {"answer": {"text": text, "cited_sources": cited}, "sources": sources}, filters, False)


def save(result: dict, folder: str) -> str:
    """Write a run file: <date>_<8 hex>_query.json or _ask.json; the result then names it."""
    day = result["generated_at"][:10].replace("-", "")
    path = Path(folder) / f"{day}_{result['run_id'][:8]}_{'ask' if result['run_type'] == 'ask_rag' else 'query'}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(result | {"output_path": str(path)}, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return str(path)


def contract_errors(result: dict) -> list[str]:
    """What a query result lacks of the contract."""
    lacks = lambda what, where, names: [f"{what} lacks {k}" for k in names if k not in where]
    found = lacks("the result", result, REQUIRED)
    if found:
        return found
    if result["schema_version"] != SCHEMA_VERSION or result["run_type"] != "query_rag":
        found.append("another schema or run type")
    found += lacks("retrieval", result["retrieval"], RETRIEVAL)
    if not found and len(result["results"]) > result["retrieval"]["top_k"]:
        found.append("more results than top_k")
    for i, r in enumerate(result["results"], 1):
        own = lacks(f"result {i}", r, RESULT)
        found += own or [*lacks(f"scores of {i}", r["scores"], SCORES), *lacks(f"chunk of {i}", r["chunk"], CHUNK)]
        if not own and r["rank"] != i:
            found.append(f"result {i} has rank {r['rank']}")
    return found
