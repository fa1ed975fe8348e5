"""Tables of the knowledge base, and the checks that stand in for database constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


NODE_REF = "struct<node_id:string,path:string,heading:string,char_start:int,char_end:int>"
_REF = T.StructType([T.StructField(n, T.StringType()) for n in ("node_id", "path", "heading")] + [T.StructField(n, T.IntegerType()) for n in ("char_start", "char_end")])
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "floats": T.ArrayType(T.FloatType()), "refs": T.ArrayType(_REF)}


def _schema(columns: str) -> T.StructType:
    """From "name kind, name kind not null, ..."; needs no session."""
    parts = [c.split() for c in columns.split(", ")]
    return T.StructType([T.StructField(p[0], _KINDS[p[1]], len(p) == 2) for p in parts])


TABLES = {
    "documents": _schema("document_id string not null, title string not null, source_org string not null, doc_type string not null, created_at timestamp not null"),
    "document_versions": _schema("version_id string not null, document_id string not null, status string not null, source_url string not null, final_url string, http_status int, captured_at timestamp, content_hash string not null, created_at timestamp not null"),
    "nodes": _schema("node_id string not null, version_id string not null, node_index int not null, kind string not null, path string not null, parent_id string, heading_text string not null, heading_level int not null, text_normalized string not null"),
    "embedding_chunks": _schema("chunk_id string not null, version_id string not null, pipeline_version string not null, chunk_index int not null, chunk_hash string not null, text string not null, node_refs refs not null, tokens_count int not null, created_at timestamp not null"),
    "chunk_embeddings": _schema("chunk_id string not null, embedding_model_id string not null, pipeline_version string not null, embedding floats not null, created_at timestamp not null"),
    "jobs": _schema("job_id long not null, type string not null, payload string not null, status string not null, attempts int not null, run_after timestamp not null, locked_at timestamp, locked_by string, last_error string, created_at timestamp not null, updated_at timestamp not null"),
    "rag_runs": _schema("run_id string not null, asked_at timestamp not null, question string not null, filters string not null, retrieval_params string not null, embedding_model_id string not null, llm_model_id string not null, pipeline_version string not null, selected string not null, answer_text string not null, insufficient_evidence boolean not null, result_json string not null, result_hash string not null, created_at timestamp not null"),
}
UNIQUE = {
    "documents": [["document_id"]],
    "document_versions": [["version_id"], ["content_hash"]],
    "nodes": [["node_id"], ["version_id", "node_index"], ["version_id", "path"]],
    "embedding_chunks": [["chunk_id"], ["version_id", "pipeline_version", "chunk_hash"]],
    "chunk_embeddings": [["chunk_id", "embedding_model_id", "pipeline_version"]],
    "jobs": [["job_id"]],
    "rag_runs": [["run_id"]],
}
#: The states of versions and jobs.
VERSION_STATES = ["READY_FOR_INDEX", "INDEXED"]
JOB_STATES = ["queued", "running", "done", "failed", "dead"]
ALLOWED = {
    "document_versions": "status IN ('READY_FOR_INDEX', 'INDEXED')",
    "nodes": "heading_level BETWEEN 1 AND 6",
    "jobs": "status IN ('queued', 'running', 'done', 'failed', 'dead')",
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """rule, n: how many rows or keys break each rule of the table; no rows if none does."""
    found = []
    for field in TABLES[table].fields:
        if not field.nullable:
            found.append(df.select(F.lit(f"{field.name} is null").alias("rule"), F.col(field.name).isNull().alias("bad")))
    if table in ALLOWED:
        found.append(df.select(F.lit(f"not {ALLOWED[table]}").alias("rule"), (~F.expr(ALLOWED[table])).alias("bad")))
    for key in UNIQUE[table]:
        groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        found.append(groups.select(F.lit(f"repeated {', '.join(key)}").alias("rule"), (F.col("n") > 1).alias("bad")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.where("bad").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def checked(df: DataFrame, table: str) -> DataFrame:
    """df in the table's columns and types; broken rules are an error."""
    out = df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table].fields))
    broken = violations(out, table).collect()  # one row a rule at most
    if broken:
        raise ValueError(f"{table}: " + "; ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return out
