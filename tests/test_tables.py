"""Stored tables: partitions that are left alone, vectors by content, numbered lines, chunking as a table function."""

import os
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.functions import embed, fts
from sextant.functions.text import canonical_text
from sextant.operators import chunk
from sextant.operators.partitioned import PartitionedTable, bucket_of
from sextant.operators.stored import StoredIndex
from sextant.sources.pages import json_lines_report, numbered_lines

ROWS = T.StructType([T.StructField(n, T.StringType()) for n in ("version_id", "pipeline_version", "text")])


def files(path):
    return {os.path.join(a, f): (os.stat(os.path.join(a, f)).st_mtime_ns, os.stat(os.path.join(a, f)).st_ino) for a, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    table = PartitionedTable(spark, path, ROWS, buckets=8)
    assert table.read().collect() == []
    rows = [(f"v{i}", "p1" if i % 3 else "p 2/x", f"t{i}") for i in range(60)]
    table.append(spark.createDataFrame(rows, ROWS))
    before = files(path)
    bucket = {r["v"]: r["b"] for r in spark.createDataFrame([(v,) for v, _, _ in rows], "v string").select("v", bucket_of(F.col("v"), 8).alias("b")).collect()}
    gone = spark.createDataFrame([("v1",), ("v2",)], "version_id string")
    n = table.replace(spark.createDataFrame([("v1", "p1", "new"), ("v1", "p1", "new2"), ("v1", "p3", "not of this pipeline")], ROWS), gone, "p1")
    want = {r for r in rows if not (r[0] in ("v1", "v2") and r[1] == "p1")} | {("v1", "p1", "new"), ("v1", "p1", "new2")}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    touched = {bucket["v1"], bucket["v2"]}
    assert n == len(touched)
    after = files(path)
    for f, stamp in before.items():
        if not any(f"pipeline_version=p1/bucket={b}/" in f for b in touched):
            assert after[f] == stamp  # untouched
    # a second run changes no rows
    table.replace(spark.createDataFrame([("v1", "p1", "new"), ("v1", "p1", "new2")], ROWS), gone, "p1")
    assert {tuple(r) for r in table.read().collect()} == want
    # partitions that are left empty go
    every = spark.createDataFrame([(v,) for v, _, _ in rows], "version_id string")
    table.replace(spark.createDataFrame([], ROWS), every, "p 2/x")
    assert {tuple(r) for r in table.read().collect()} == {r for r in want if r[1] == "p1"}
    some = table.read("p1", ["v1"])
    assert {r["text"] for r in some.collect()} == {"new", "new2"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "bucket#" in filters and f"= {bucket['v1']})" in filters and "pipeline_version#" in filters


def test_known_texts_are_not_embedded_again(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.makedirs(log)

    def make():
        def provider(texts):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(f"{len(texts)}\n")
            return embed.hashed(16)(texts)

        return provider

    def asked():
        return sum(int(x) for name in os.listdir(log) for x in open(f"{log}/{name}"))

    chunks = spark.createDataFrame([(i, None if i == 7 else "" if i == 8 else f"text {i % 50}") for i in range(400)], "chunk_id int, text string").repartition(6)
    none = spark.createDataFrame([], "content_hash string, embedding_model_id string, embedding array<float>")
    rows, new = embed.embedded_once(chunks, none, make, "m@1")
    assert asked() == new.count() == 51
    want = {r["chunk_id"]: r["embedding"] for r in embed.embedded(chunks, lambda: embed.hashed(16), "m@1").collect()}
    assert {r["chunk_id"]: r["embedding"] for r in rows.collect()} == want and asked() == 51
    more = chunks.union(spark.createDataFrame([(999, "one more")], "chunk_id int, text string"))
    rows, newer = embed.embedded_once(more, new, make, "m@1")
    assert newer.count() == 1 and asked() == 52 and rows.count() == 401
    _, other = embed.embedded_once(more, new, make, "other@1")  # known under another model only
    assert other.count() == 52


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    chance = random.Random(1)
    every, path = [], tmp_path / "lines"
    os.makedirs(path)
    for k in range(3):
        lines = [chance.choice(['{"a": 1}', '{"a": 1, "a": 2}', "NaN", "", " ", "[1,", "x" * chance.randrange(300), '"é"']) for _ in range(4000)]
        (path / f"part-{k}.jsonl").write_text("\n".join(lines) + "\n")
        every += [(k, i, x) for i, x in enumerate(lines, 1)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")  # several splits a file
    try:
        got = [(int(r["file"][-7]), r["file_line"], r["value"], r["line"]) for r in numbered_lines(spark, str(path)).orderBy("line").collect()]
        report = json_lines_report(spark, str(path)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(*x, i) for i, x in enumerate(every, 1)]

    def wrong(x):
        try:
            return __import__("json").loads(x) and None
        except ValueError as e:
            return str(e)

    bad = [(i, wrong(x), x[:220]) for i, (_, _, x) in enumerate(every, 1) if x and wrong(x)]
    assert (report["total"], report["invalid"]) == (12000, len(bad))
    assert [(e["line"], e["message"], e["preview"]) for e in report["errors"]] == bad[:5]


def test_canonical_json():
    assert canonical_text('{"b": [1, {"z": 1.50, "a": null}], "a": "é"}') == '{"a":"é","b":[1,{"a":null,"z":1.5}]}'
    assert canonical_text("{") is None and canonical_text(None) is None and canonical_text("[" * 100_000) is None


def test_table_function_chunks_as_the_library_does(spark):
    chunk.register(spark)
    words = np.random.default_rng(1).integers(0, 50, 6000)
    nodes = [(f"v{i % 3}", f"n{i}", i, f"p{i}", f"Heading {i}", None if i == 4 else " ".join(f"w{x}." for x in words[i * 100 : i * 100 + 700 * (i % 2) + 50])) for i in range(50)]
    frame = spark.createDataFrame(nodes, "version_id string, node_id string, node_index int, path string, heading_text string, text_normalized string").repartition(4)
    got = spark.sql("SELECT * FROM chunk_nodes('p1', TABLE({nodes}) PARTITION BY version_id ORDER BY node_index)", nodes=frame)
    want = chunk.chunks_of(frame, "p1").drop("chunk_id")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 20


def test_a_reindex_leaves_other_partitions_alone(spark, tmp_path):
    stored = StoredIndex(spark, str(tmp_path), "simple", buckets=8)
    nodes = spark.createDataFrame([(f"v{i}", f"n{i}-{k}", k, "p", f"H{k}", f"text {i} {k} word") for i in range(12) for k in range(2)], "version_id string, node_id string, node_index int, path string, heading_text string, text_normalized string")
    versions = spark.createDataFrame([(f"v{i}", "READY_FOR_INDEX") for i in range(13)], "version_id string, status string")  # v12 has no nodes
    assert stored.index(versions, nodes, "p1", "m@1", embed.hashed, "2024-01-01 00:00:00").count() == 12
    before = files(str(tmp_path))
    rows = {r["version_id"]: r for r in stored.chunks.read().collect()}
    assert len(rows) == 12 and all("word" in r["text"] for r in rows.values())
    changed = nodes.where("version_id = 'v3'").withColumn("text_normalized", F.concat("text_normalized", F.lit(" changed")))
    stored.index(versions, changed, "p1", "m@1", embed.hashed, "2024-01-02 00:00:00", version_ids=["v3", "v12"], force=True)
    after = files(str(tmp_path))
    own = spark.createDataFrame([("v3",)], "v string").select(bucket_of(F.col("v"), 8)).first()[0]
    assert {f for f in before if f not in after} and all(f"/bucket={own}/" in f for f in before if after.get(f) != before[f])
    new = {r["version_id"]: r for r in stored.chunks.read().collect()}
    assert {v for v in new if new[v] != rows[v]} == {"v3"} and "changed" in new["v3"]["text"]
    assert stored.postings.read().where("lexeme = 'changed'").select("chunk_id").collect() == [(new["v3"]["chunk_id"],)]
    assert stored.vectors.read().count() == 12
    found = fts.search(stored.chunks.read(), fts.plain("changed", language="simple"), 5, stored.postings.read("p1"), "simple").collect()
    assert [r["chunk_id"] for r in found] == [new["v3"]["chunk_id"]]


def test_table_function_keeps_a_long_version_whole(spark, tmp_path):
    """The query against its SQL where versions exceed a chunk's usual size."""
    import duckdb

    from sextant.plans import tables  # noqa: F401  it registers its queries
    from sextant.plans.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(1 + i * 7))) for i in range(300)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    frame = QUERIES["chunk_function"](spark, str(tmp_path))
    cursor = con.execute(ORACLE_SQL["chunk_function"])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))
