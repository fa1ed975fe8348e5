"""Five stages over the documents table, each written and read again before the next.

quality: documents that the classifier rejects go. lines: lines that match an earlier line go, and
documents of which nothing is left. copies: one document of each group of near copies stays, that of
the smallest id. leaks: documents that hold a benchmark item go. tokens: ids of what is left.

Rows are judged one by one: a null or empty text is scored as an empty one, has no lines to lose, is no copy
and no leak, and has no tokens. A null id is never learnt from, has no earlier lines and is no copy, but may be
a leak. Of rows that repeat an id, each is scored and searched for leaks by its own text; equal rows become
one in copies, different texts of one id stay unless they are copies. An empty table stays empty. Columns
of any name besides doc_id and text pass through all stages but the last; n_chars, where there is one, follows
the text. Very long texts are read whole, by one task each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import _sets, bpe, decontaminate, line_dedup, ngram_join, quality
from sextant.llm._runtime import materialise

#: Near copies: Jaccard similarity of at least 4/5 over five-word shingles. Operator 1 has its own rule.
COPIES = _sets.Rule(k=5, a=4, b=5, lines=False, slots=1 << 24)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.without_lines(docs)
    empty = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(empty, F.lit(False))).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:  # the table's column follows the text
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs, COPIES).select(docs.columns)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("copies", copies_stage), ("leaks", leaks_stage), ("tokens", tokens_stage)]

#: The classifier and the tokenizer can't be put in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
