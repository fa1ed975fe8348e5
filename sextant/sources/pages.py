"""Sources: landed pages, URL lists, run files, gzipped JSON lines; and pages to document trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .html import content_hash, extract

SECTIONS = "array<struct<node_index:int,heading_level:int,heading_text:string,path:string,parent_path:string,text:string>>"


def url_list(path: str, prefix: str = "URL_") -> list[tuple[str, str]]:
    """(name, url) of the lines NAME=value whose name begins with prefix and whose value isn't empty, by name."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    found = re.findall(rf"^\s*(?:export\s+)?({prefix}\w*)=[\"']?([^\"'\n]+)", Path(path).read_text(), re.M)
    urls = sorted((name, value.strip()) for name, value in found if value.strip())
    if not urls:
        raise ValueError(f"{path} names no {prefix}*")
    return urls


def fetch(urls: list[str], timeout: int = 30) -> Iterator[dict]:
    """Pages by HTTP: html, final_url, http_status, captured_at; other than success is an error."""
    import datetime
    import urllib.request

    for url in urls:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "sextant/1"}), timeout=timeout) as reply:
            body = reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")
            yield {"url": url, "html": body, "final_url": reply.geturl(), "http_status": reply.status, "captured_at": datetime.datetime.now(datetime.timezone.utc)}


class PageSource(DataSource):
    """Pages by HTTP as a batch source: spark.dataSource.register(PageSource), then
    spark.read.format("pages").option("urls", "one a line").load(). A task fetches PER_TASK pages."""

    PER_TASK = 16

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string, final_url string, http_status int, captured_at timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options.get("urls", "").split(), int(self.options.get("timeout", "30")), self.PER_TASK)


class _PageReader(DataSourceReader):
    def __init__(self, urls: list[str], timeout: int, per_task: int):
        self.urls, self.timeout, self.per_task = urls, timeout, per_task

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.urls[i : i + self.per_task]) for i in range(0, len(self.urls), self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in fetch(partition.value, self.timeout):
            yield page["url"], page["html"], page["final_url"], page["http_status"], page["captured_at"]


def parsed(pages: DataFrame, deepest: int = 3, closed: bool = False) -> DataFrame:
    """pages (url, html, other columns) with title, content_hash and sections. closed: see html.parse."""
    keep = [c for c in pages.columns if c not in ("html", "title", "content_hash", "sections")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [extract(h, deepest, closed) for h in batch["html"]]
            out = batch[keep].copy()
            out["title"] = [t for t, _ in rows]
            out["content_hash"] = [content_hash(s) for _, s in rows]
            out["sections"] = [[{"node_index": i, "heading_level": x.heading_level, "heading_text": x.heading_text, "path": x.path, "parent_path": x.parent_path, "text": x.text} for i, x in enumerate(s)] for _, s in rows]
            yield out

    return pages.mapInPandas(run, f"{schema}, title string, content_hash string, sections {SECTIONS}")


def latest_run(spark: SparkSession, folder: str, suffix: str = "_query.json", by_name: bool = False) -> DataFrame:
    """path and json of the newest run file: by modification time (ties by name), or by name with its numbers in order.

    Only the listing is read to find it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "modificationTime")
    name = F.transform(F.regexp_extract_all(F.substring_index("path", "/", -1), F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 20, "0")).otherwise(x))
    order = [F.array_join(name, "").desc()] if by_name else [F.desc("modificationTime"), F.desc("path")]
    found = files.orderBy(*order).limit(1).select("path").collect()  # one row
    if not found:
        return spark.createDataFrame([], "path string, json string")
    return spark.read.text(found[0]["path"], wholetext=True).select(F.lit(found[0]["path"]).alias("path"), F.col("value").alias("json"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, file_line, value: all lines of text files, numbered from 1 over the files in the order of their names, and in each.

    No task sees more than its splits: lines keep the order of their split, splits are counted, and the counts before each are added.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    splits = read.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("begin"))
    before = "coalesce(sum(n) OVER ({} ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    splits = splits.selectExpr("file", "split", "begin", before.format("", "file, split") + " AS earlier", before.format("PARTITION BY file", "split") + " AS file_earlier")  # a row a split
    place = F.col("at") - F.col("begin") + 1
    return read.join(splits, ["file", "split"]).select("file", (F.col("earlier") + place).alias("line"), (F.col("file_earlier") + place).alias("file_line"), "value")


def json_error(line: str) -> str | None:
    """What is wrong with a line, nothing if it is JSON."""
    try:
        json.loads(line)
    except (ValueError, RecursionError) as e:
        return str(e)
    return None


@F.pandas_udf(T.StringType())
def _errors(lines: pd.Series) -> pd.Series:
    return lines.map(json_error)


def invalid_lines(lines: DataFrame) -> DataFrame:
    """lines (value and others) that are no JSON, with message; empty lines aren't invalid, lines of white space are.

    Only lines that Spark can't read as a variant go through Python, which decides (repeated keys and NaN are allowed there)."""
    doubtful = lines.where((F.col("value") != "") & F.try_parse_json("value").isNull())
    return doubtful.withColumn("message", _errors("value")).where(F.col("message").isNotNull())


def lines_report(lines: DataFrame, first: int = 5, shown: int = 220) -> DataFrame:
    """total, invalid and errors: of the first invalid lines (line, value; file too if there) their number, message and beginning."""
    bad = invalid_lines(lines)
    names = [c for c in ("file", "file_line") if c in lines.columns]
    errors = bad.select(*names, "line", "message", F.left("value", F.lit(shown)).alias("preview")).orderBy("line").limit(first)
    found = errors.agg(F.array_sort(F.collect_list(F.struct("line", *names, "message", "preview"))).alias("errors"))
    totals = lines.agg(F.count(F.lit(1)).alias("total"))
    return totals.crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("invalid")))).crossJoin(F.broadcast(found))  # one row each


def json_lines_report(spark: SparkSession, path: str) -> DataFrame:
    return lines_report(numbered_lines(spark, path))
