"""Audit of how filters interact, from a histogram of failure masks (operator 12).

Each document gets a five-bit mask, a bit a filter it fails. What any order of the filters removes, and
what it costs, follows from how many documents of a part have each of the 32 masks; so the documents are read
once and all 120 orders are worked out from the cells.

The first four bits are expressions of the text. The fifth says that a smaller id has the same text anywhere
in the table: texts are grouped by their SHA-256, first by task, so that a text which a third of all rows hold
is a few rows of a shuffle, and its least id is spread over those few rows.

Rows: a null text is empty, a null part the empty string. A null id is never a duplicate, makes none, and has no
label. Rows that repeat an id with the same text are not each other's duplicates (no id is smaller), and each
counts. A document has a label if any row of labels says so. An empty table gives no rows. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: What separates words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """Whether each of the filters A to D removes a text."""
    words = F.array_remove(F.split(text, SPACE), "")
    n_words = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        n_words < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PCT * n_words,
        100 * capitals > MAX_CAPITALS_PCT * F.length(text),
        text.rlike(SYMBOLS),
    ]


def _mask(failures: list[Column]) -> Column:
    total = F.lit(0)
    for k, fails in enumerate(failures):
        total = total.bitwiseOR(F.shiftleft(fails.cast("int"), k))
    return total


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, mask, n, good and toxic: a row for each part and mask that documents have, 32 a part at most."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("body"))
    masked = read.select("id", "part", _mask(text_failures(F.col("body"))).alias("mask"), F.sha2("body", 256).alias("address"))
    # rows that repeat an id and its text are one row from here on
    rows = masked.groupBy("id", "part", "mask", "address").agg(F.count(F.lit(1)).alias("n"))
    said = labels.select(F.col("doc_id").cast("string").alias("label_id"), (F.col("quality") == 1).alias("is_good"), (F.col("toxic") == 1).alias("is_toxic"))
    said = said.where("label_id is not null").groupBy("label_id").agg(F.coalesce(F.bool_or("is_good"), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or("is_toxic"), F.lit(False)).alias("is_toxic"))
    # a null id finds no label; its rows are dealt by text, so they don't meet in one task
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("address")))
    rows = rows.withColumn("label_id", key).join(said, "label_id", "left").na.fill(False, ["is_good", "is_toxic"])
    # the least id of a text with its number of rows, for each kind of row that has the text
    kinds = rows.groupBy("address", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    lowest = F.min("least.id").over(Window.partitionBy("address"))
    kinds = kinds.withColumn("first_rows", F.col("n_null") + F.when(F.col("least.id") == lowest, F.col("least.n")).otherwise(0))
    repeat = 1 << FILTERS.index("E")
    states = F.explode(F.array(F.struct(F.col("mask").alias("full"), F.col("first_rows").alias("rows")), F.struct((F.col("mask") + repeat).alias("full"), (F.col("n") - F.col("first_rows")).alias("rows"))))
    found = kinds.select("part", "is_good", "is_toxic", states.alias("s")).where("s.rows > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("s.rows")).otherwise(0))
    return found.groupBy("part", F.col("s.full").alias("mask")).agg(F.sum("s.rows").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def steps() -> Column:
    """The 600 steps of all orders: filter_order, step, own (the filter's bit) and before (bits of those applied earlier)."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": k, "own": own, "before": before})
            before |= own
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, own: int, before: int>>")


def orders(histogram: DataFrame) -> DataFrame:
    """What each step of each order keeps, removes and costs, worked out from the cells of each part."""
    parts = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(steps()).alias("s")).select("part", "cells", "s.*")

    def total(what: str, test) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(test(c["mask"]), c[what]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    left = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & left(m)
    out = rows.select(
        "part",
        "filter_order",
        "step",
        "own",
        total("n", lambda m: m.bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & ~left(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step."""
    return orders(cells(docs, labels, text, doc_id, part))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lowest
  FROM documents),
flags AS (
  SELECT part, doc_id,
         len(words) < 200 AS a,
         100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(lowest < doc_id, false) AS e
  FROM d),
marked AS (
  SELECT f.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.toxic = 1) AS toxic
  FROM flags f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perms AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x
    AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
steps AS (SELECT filter_order, s::INTEGER AS step, substr(filter_order, s, 1) AS own, substr(filter_order, 1, s - 1) AS before FROM perms, range(1, 6) r(s)),
fails AS (SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n FROM marked GROUP BY ALL),
rows_ AS (
  SELECT part, filter_order, step, own, n, good, toxic, failed, contains(failed, own) AS fails,
         len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND before <> '' AND failed <> '' AS gone
  FROM fails, steps),
summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM rows_ GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM summed
"""
