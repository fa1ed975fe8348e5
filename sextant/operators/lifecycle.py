"""Jobs, indexing and audit as rewrites of whole tables: state in, state out; "now" is a parameter."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fts
from ..functions.embed import embedded
from ..functions.text import canonical_json
from .chunk import Sizes, chunks_of

LEASE_S, RETRY_S = 900, 15
#: Payloads that one task numbers, and jobs that a drain leases at once.
SLICE_ROWS, BATCH = 1_000_000, 64


def _now(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _after(now: str, seconds: int) -> Column:
    return _now(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def enqueue(jobs: DataFrame, payloads: DataFrame, kind: str, now: str) -> DataFrame:
    """jobs with a queued job for each row of payloads (payload), numbered on from the largest id."""
    top = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0))).first()[0]
    # ids are dealt by rank of the payload within its hash slice; slices follow the number of payloads, so no task sorts many
    slices = max(64, -(-payloads.count() // SLICE_ROWS))
    rows = payloads.select("payload", F.pmod(F.xxhash64("payload"), F.lit(slices)).alias("s"))
    begin = rows.groupBy("s").count().selectExpr("s", "sum(count) OVER (ORDER BY s) - count AS begin")  # a row a slice
    rows = rows.selectExpr("payload", "s", "row_number() OVER (PARTITION BY s ORDER BY payload) AS n").join(begin, "s")
    new = rows.select((F.lit(top) + F.col("begin") + F.col("n")).cast("long").alias("job_id"), F.lit(kind).alias("type"), "payload", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), _now(now).alias("run_after"), F.lit(None).cast("timestamp").alias("locked_at"), F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("string").alias("last_error"), _now(now).alias("created_at"), _now(now).alias("updated_at"))
    return jobs.unionByName(new)


def eligible(jobs: DataFrame, now: str, lease_s: int = LEASE_S) -> DataFrame:
    """Due jobs, and running ones whose lease is over."""
    due = F.col("status").isin("queued", "failed") & (F.col("run_after") <= _now(now))
    return jobs.where(due | ((F.col("status") == "running") & (F.col("locked_at") < _after(now, -lease_s))))


def lease(jobs: DataFrame, worker: str, now: str, lease_s: int = LEASE_S, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """The first n eligible jobs by run_after and id, and jobs with them running; attempts stay as they are."""
    taken = eligible(jobs, now, lease_s).orderBy("run_after", "job_id").limit(n)
    ids = F.broadcast(taken.select("job_id", F.lit(True).alias("_mine")))  # n rows
    mine, reclaimed = F.col("_mine").isNotNull(), F.col("status") == "running"
    note = F.concat_ws("\n", F.col("last_error"), F.lit("reclaimed: lease expired"))
    out = jobs.join(ids, "job_id", "left")
    out = out.withColumns({"last_error": F.when(mine & reclaimed, note).otherwise(F.col("last_error")), "status": F.when(mine, "running").otherwise(F.col("status")), "locked_at": F.when(mine, _now(now)).otherwise(F.col("locked_at")), "locked_by": F.when(mine, F.lit(worker)).otherwise(F.col("locked_by")), "updated_at": F.when(mine, _now(now)).otherwise(F.col("updated_at"))})
    return taken, out.select(jobs.columns)


def settled(jobs: DataFrame, job_id: int, status: str, now: str, error: str | None = None, retry_s: int = RETRY_S, most: int | None = None) -> DataFrame:
    """jobs after one is done, failed (again later; dead after most attempts, if given) or dead."""
    mine = F.col("job_id") == job_id
    attempts = F.col("attempts") + F.when(mine & F.lit(status == "failed"), 1).otherwise(0)
    state = F.when((attempts >= most) & F.lit(status == "failed"), "dead").otherwise(status) if most is not None else F.lit(status)
    message = F.concat_ws("\n", F.col("last_error"), F.lit(error)) if error else F.col("last_error")
    free = lambda c: F.when(mine, F.lit(None)).otherwise(F.col(c)).alias(c)
    new = {"attempts": attempts.cast("int"), "status": F.when(mine, state).otherwise(F.col("status")), "last_error": F.when(mine, message).otherwise(F.col("last_error")), "run_after": F.when(mine & F.lit(status == "failed"), _after(now, retry_s)).otherwise(F.col("run_after")), "updated_at": F.when(mine, _now(now)).otherwise(F.col("updated_at"))}
    return jobs.select(*(free(c) if c in ("locked_at", "locked_by") else new[c].alias(c) if c in new else F.col(c) for c in jobs.columns))


def rearm(jobs: DataFrame, now: str) -> DataFrame:
    """Failed jobs due at once."""
    failed = F.col("status") == "failed"
    return jobs.withColumns({"run_after": F.when(failed, _now(now)).otherwise(F.col("run_after")), "updated_at": F.when(failed, _now(now)).otherwise(F.col("updated_at")), "status": F.when(failed, "queued").otherwise(F.col("status"))})


class PermanentError(Exception):
    """A job that no retry can mend."""


def settle_all(jobs: DataFrame, outcomes: list[tuple[int, str, str | None]], now: str, retry_s: int = RETRY_S) -> DataFrame:
    """jobs after a batch of outcomes (job_id, status, error), by one join."""
    known = jobs.sparkSession.createDataFrame(outcomes, "job_id long, _status string, _error string")
    out = jobs.join(F.broadcast(known), "job_id", "left")  # a batch of rows
    mine, failed = F.col("_status").isNotNull(), F.col("_status") == "failed"
    free = lambda c: F.when(mine, F.lit(None)).otherwise(F.col(c))
    new = {"attempts": (F.col("attempts") + F.when(failed, 1).otherwise(0)).cast("int"), "status": F.coalesce("_status", "status"), "last_error": F.when(F.col("_error").isNotNull(), F.concat_ws("\n", "last_error", "_error")).otherwise(F.col("last_error")), "run_after": F.when(failed, _after(now, retry_s)).otherwise(F.col("run_after")), "updated_at": F.when(mine, _now(now)).otherwise(F.col("updated_at")), "locked_at": free("locked_at"), "locked_by": free("locked_by")}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns))


def work_off(jobs: DataFrame, work: Callable[[dict], None], worker: str, now: str, cut: Callable[[DataFrame], DataFrame], batch: int = BATCH) -> tuple[DataFrame, int]:
    """Lease a batch of eligible jobs, work them off, and settle them together; the jobs and how many there were."""
    taken, jobs = lease(jobs, worker, now, n=batch)
    rows = taken.collect()  # a batch
    if not rows:
        return jobs, 0
    jobs, outcomes = cut(jobs), []
    for row in rows:
        try:
            work(row.asDict(recursive=True))
            outcomes.append((row["job_id"], "done", None))
        except PermanentError as e:
            outcomes.append((row["job_id"], "dead", str(e)))
        except Exception as e:  # noqa: BLE001  any other failure is tried again
            outcomes.append((row["job_id"], "failed", f"{type(e).__name__}: {e}"))
    return cut(settle_all(jobs, outcomes, now)), len(rows)


def drain(jobs: DataFrame, work: Callable[[dict], None], worker: str, now: str, cut: Callable[[DataFrame], DataFrame], batch: int = BATCH) -> DataFrame:
    """Work off all queued jobs, a batch at a time; failed ones aren't waited for. cut ends the lineage of a state."""
    while not jobs.where("status = 'queued'").isEmpty():
        jobs, n = work_off(jobs, work, worker, now, cut, batch)
        if not n:
            break
    return jobs


def poll(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], work: Callable[[dict], None], worker: str, clock: Callable[[], str], cut: Callable[[DataFrame], DataFrame], once: bool = False, sleep_s: float = 5.0, wait: Callable[[float], None] = time.sleep) -> int:
    """The worker's loop: one job (once), or jobs for ever with a pause where there is none; how many were done."""
    total = 0
    while True:
        jobs, n = work_off(read(), work, worker, clock(), cut, 1 if once else BATCH)
        if n:
            write(jobs)
        total += n
        if once:
            return total
        if not n:
            wait(sleep_s)


def index_versions(versions: DataFrame, nodes: DataFrame, pipeline_version: str, sizes: Sizes = Sizes(), version_ids: list[str] | DataFrame | None = None, force: bool = False) -> DataFrame:
    """Chunks of all versions that wait for it (with force also of indexed ones)."""
    ready = versions if force else versions.where("status = 'READY_FOR_INDEX'")
    if isinstance(version_ids, DataFrame):
        ready = ready.join(version_ids.select("version_id"), "version_id", "left_semi")
    elif version_ids is not None:
        ready = ready.where(F.col("version_id").isin(version_ids))
    return chunks_of(nodes.join(ready.select("version_id"), "version_id", "left_semi"), pipeline_version, sizes)


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows of new's keys, then new: an idempotent rebuild."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


@dataclass
class Indexed:
    """The whole tables after an indexing run; status is written last."""

    chunks: DataFrame
    embeddings: DataFrame
    postings: DataFrame
    versions: DataFrame


def reindex(versions: DataFrame, nodes: DataFrame, chunks: DataFrame, embeddings: DataFrame, postings: DataFrame, pipeline_version: str, model_id: str, make: Callable, now: str, sizes: Sizes = Sizes(), version_ids: list[str] | DataFrame | None = None, force: bool = False, language: str = "portuguese") -> Indexed:
    """Chunk, embed and post all versions that wait for it, in place of what they had under this pipeline.

    A version without nodes is left waiting. Embeddings and postings of chunks that go, go with them.
    """
    new = index_versions(versions, nodes, pipeline_version, sizes, version_ids, force).withColumn("created_at", _now(now))
    done = new.select("version_id").distinct()
    old = chunks.join(done.withColumn("pipeline_version", F.lit(pipeline_version)), ["version_id", "pipeline_version"], "left_semi").select("chunk_id")
    vectors = embedded(new.select("chunk_id", "pipeline_version", "text", "created_at"), make, model_id).drop("text")
    without = lambda df: df.join(old, "chunk_id", "left_anti")
    return Indexed(without(chunks).unionByName(new.select(chunks.columns)), without(embeddings).unionByName(vectors.select(embeddings.columns)), without(postings).unionByName(fts.postings(new, language=language)), mark_indexed(versions, done))


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Of new, one row (the least id) of each key that old has not: insert, and do nothing on conflict."""
    first = new.groupBy(*keys).agg(F.min("chunk_id").alias("chunk_id"))
    return new.join(first, [*keys, "chunk_id"], "left_semi").join(old.select(keys), keys, "left_anti").select(old.columns)


def mark_indexed(versions: DataFrame, done: DataFrame) -> DataFrame:
    """versions with those in done (version_id) INDEXED: the last write of an indexing run."""
    flag = done.select("version_id").distinct().withColumn("_done", F.lit(True))
    return versions.join(flag, "version_id", "left").withColumn("status", F.when(F.col("_done"), "INDEXED").otherwise(F.col("status"))).select(versions.columns)


def stable_hash(result: dict) -> str:
    """SHA-256 of the canonical JSON without what differs from run to run."""
    return hashlib.sha256(canonical_json({k: v for k, v in result.items() if k not in ("generated_at", "run_id", "output_path")}).encode()).hexdigest()


def audit_row(spark: SparkSession, result: dict, now: str, model: str, pipeline_version: str) -> DataFrame:
    """The rag_runs row of a query or ask result."""
    from ..schemas import TABLES

    asked = result["run_type"] == "ask_rag"
    answer = result.get("answer") or {}
    picked = answer.get("cited_sources", []) if asked else [r["chunk"]["chunk_id"] for r in result["results"]]
    rows = result.get("sources") if asked else result["results"]
    row = {"run_id": result["run_id"], "question": result["query"], "filters": canonical_json(result["filters"]), "retrieval_params": canonical_json(result["params"]), "embedding_model_id": model, "llm_model_id": "extractive" if asked else "none", "pipeline_version": pipeline_version, "selected": canonical_json(picked), "answer_text": answer.get("text", ""), "insufficient_evidence": not rows, "result_json": canonical_json(result), "result_hash": stable_hash(result)}
    frame = spark.createDataFrame([json.loads(json.dumps(row))], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in row.items()))
    return frame.withColumns({"asked_at": _now(now), "created_at": _now(now)}).select(*(f.name for f in TABLES["rag_runs"].fields))


def new_run_id() -> str:
    return uuid.uuid4().hex
