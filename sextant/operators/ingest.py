"""Pages to documents, versions and nodes; idempotent by content."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_count
from ..scratch import release, written


def digest(*columns):
    return F.sha2(F.concat_ws("|", *columns), 256)


@dataclass
class Landing:
    documents: DataFrame
    versions: DataFrame
    nodes: DataFrame
    refreshed: DataFrame
    rejected: DataFrame
    parsed: DataFrame

    def done(self) -> None:
        """All has been written: the parsed pages go before the driver ends."""
        release(self.parsed)


def node_rows(parsed: DataFrame) -> DataFrame:
    """One row a section, with deterministic ids and the parent that stands before it.

    parsed: version_id and sections; the parent is looked for in the version's own sections, so pages are parsed once and no text is shuffled.
    """
    before = lambda s: F.exists("sections", lambda p: (p["path"] == s["parent_path"]) & (p["node_index"] < s["node_index"]))
    names = ("node_index", "heading_level", "heading_text", "path", "parent_path", "text")
    own = F.transform("sections", lambda s: F.struct(*(s[n].alias(n) for n in names), before(s).alias("has_parent")))
    rows = parsed.select("version_id", F.inline(own))
    return rows.select("version_id", digest("version_id", "path").alias("node_id"), "node_index", F.lit("heading_section").alias("kind"), "path", F.coalesce("heading_text", F.lit("")).alias("heading_text"), "heading_level", F.coalesce("text", F.lit("")).alias("text_normalized"), F.when(F.col("has_parent"), digest("version_id", "parent_path")).alias("parent_id"))


def repeated_paths(parsed: DataFrame) -> DataFrame:
    """version_id, n, sample (10 paths at most) of the versions in which a path repeats."""
    own = parsed.select("version_id", F.inline("sections")).groupBy("version_id", "path").count().where("count > 1")
    first = own.withColumn("r", F.row_number().over(Window.partitionBy("version_id").orderBy("path")))
    return first.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 10, F.col("path")))).alias("sample"))


def size_report(nodes: DataFrame) -> DataFrame:
    """version_id, longest and p95 size in words of the nodes that aren't blank (0 if none): element floor(0.95 (n-1)).

    Sizes are counted first, so a version is as many rows as it has different sizes.
    """
    sizes = nodes.select("version_id", word_count(F.col("text_normalized")).alias("size"))
    counts = sizes.groupBy("version_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.coalesce("size", F.lit(0)) > 0, F.col("n")).otherwise(0))
    own = Window.partitionBy("version_id")
    counts = counts.withColumns({"upto": F.sum("n").over(own.orderBy("size")), "total": F.sum("n").over(own)})
    reached = (F.col("n") > 0) & (F.col("upto") > F.floor(F.lit(0.95) * (F.col("total") - 1)))
    return counts.groupBy("version_id").agg(F.coalesce(F.max(F.when(F.col("n") > 0, F.col("size"))), F.lit(0)).alias("longest"), F.coalesce(F.min(F.when(reached, F.col("size"))), F.lit(0)).alias("p95"))


def land(parsed: DataFrame, documents: DataFrame, versions: DataFrame, source_org: str, doc_type: str, now: str) -> Landing:
    """What a batch of parsed pages adds to the knowledge base.

    parsed: url, title, content_hash, sections, and optionally final_url, http_status, captured_at. A content
    known under any URL only refreshes capture data; of equal contents in the batch the smallest URL
    wins; a version with repeated paths is rejected alone; a new document has the least title of its versions.
    parsed is written once and read again, so that pages are parsed once, also if executors are lost: see Landing.done.
    """
    stamp = F.lit(now).cast("timestamp")
    for name, kind in (("final_url", "string"), ("http_status", "int"), ("captured_at", "timestamp")):
        if name not in parsed.columns:
            parsed = parsed.withColumn(name, F.lit(None).cast(kind))
    parsed = written(parsed, "landed")
    batch = parsed.withColumn("version_id", digest(F.lit("version"), "content_hash"))
    first = Window.partitionBy("content_hash").orderBy("url", F.col("captured_at").desc())
    batch = batch.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    known = versions.select("content_hash", F.col("version_id").alias("known_version"))
    seen = batch.join(known, "content_hash")
    refreshed = seen.select(F.col("known_version").alias("version_id"), "final_url", "http_status", "captured_at")
    fresh = batch.join(known.select("content_hash"), "content_hash", "left_anti")
    rejected = repeated_paths(fresh)
    fresh = fresh.join(rejected.select("version_id"), "version_id", "left_anti")
    # a document is known by either of its URLs: two equi-joins' worth of keys instead of an OR
    keys = versions.select("document_id", F.explode(F.array_distinct(F.array("source_url", F.coalesce("final_url", "source_url")))).alias("url")).groupBy("url").agg(F.min("document_id").alias("known_document"))
    owned = fresh.join(keys, "url", "left").withColumn("document_id", F.coalesce("known_document", digest(F.lit("document"), "url")))
    titles = owned.where("known_document IS NULL").groupBy("document_id").agg(F.coalesce(F.min(F.nullif("title", F.lit(""))), F.lit("Documento")).alias("title"))
    new_documents = titles.join(documents.select("document_id"), "document_id", "left_anti").select("document_id", "title", F.lit(source_org).alias("source_org"), F.lit(doc_type).alias("doc_type"), stamp.alias("created_at"))
    new_versions = owned.select("version_id", "document_id", F.lit("READY_FOR_INDEX").alias("status"), F.col("url").alias("source_url"), "final_url", "http_status", "captured_at", "content_hash", stamp.alias("created_at"))
    return Landing(new_documents, new_versions, node_rows(owned), refreshed, rejected, parsed)


def index_requests(landing: Landing, pipeline_version: str, model_id: str, reindex_existing: bool = False) -> DataFrame:
    """payload: a job for each new version; with reindex_existing also for known contents that were met again, by force."""
    body = lambda *more: F.to_json(F.struct("version_id", F.lit(pipeline_version).alias("pipeline_version"), F.lit(model_id).alias("embedding_model_id"), *more)).alias("payload")
    new = landing.versions.select(body())
    return new.unionByName(landing.refreshed.select("version_id").distinct().select(body(F.lit(True).alias("force")))) if reindex_existing else new


def refresh(versions: DataFrame, refreshed: DataFrame) -> DataFrame:
    """versions with newer capture data where a known content was met again."""
    new = refreshed.groupBy("version_id").agg(*(F.max_by(c, F.struct("captured_at", "final_url")).alias(f"_{c}") for c in ("final_url", "http_status", "captured_at")))
    out = versions.join(new, "version_id", "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("final_url", "http_status", "captured_at") else F.col(c) for c in versions.columns))
