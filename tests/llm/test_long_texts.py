"""Very long texts, among short ones, through every operator that reads texts."""

import hashlib

from sextant.llm import bpe, decontaminate, kneser_ney, line_dedup, ngram_join, quality, repeats, unigram, warc
from sextant.llm._runtime import scratch_path

LONG = " ".join(f"w{i % 9973}x{i % 89}" for i in range(300_000))  # 2.9 MB
ITEM = " ".join(f"item{i}" for i in range(30))


def table(spark):
    return spark.createDataFrame([(1, LONG), (2, LONG + " " + ITEM), (3, "short"), (4, None), (5, LONG)], "doc_id long, text string").repartition(2)


def test_sets(spark):
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.linked(table(spark)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 5: (1, 2), 3: (3, 0), 4: (4, 0)}
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.without_lines(table(spark)).collect()}
    assert kept == {1: LONG, 2: "", 3: "short", 4: None, 5: ""}


def test_models(spark):
    docs = table(spark)
    model = kneser_ney.learn(docs)
    rows = {r["doc_id"]: r for r in kneser_ney.score(docs, model).drop("text").collect()}
    assert rows[1]["n_tokens"] == 300_001 == rows[1]["n_known"] and rows[1]["score"] == rows[5]["score"] and rows[4]["n_tokens"] == 1
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert scores[1] == scores[5] and all(0 <= s <= 1 for s in scores.values())


def test_tokens(spark):
    docs = table(spark)
    counts = {r["doc_id"]: r["n_tokens"] for r in unigram.count_tokens(docs, unigram.public_counter()).collect()}
    assert counts[1] == counts[5] > 300_000 and counts[4] == 0
    ids = {r["doc_id"]: r for r in bpe.digests(docs).collect()}
    assert ids[1]["ids_sha256"] == ids[5]["ids_sha256"] and ids[1]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()


def test_windows_and_repeats(spark):
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in decontaminate.leaks(table(spark), items).collect()] == [(2, 300_000)]
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in repeats.without_repeats(table(spark)).collect()}
    assert got[1] == (0, LONG.encode()) and got[5] == (len(LONG), b"") and got[2] == (len(LONG), f" {ITEM}".encode())


def test_payloads(spark):
    path = scratch_path(spark, "long-warc")
    pages = table(spark).selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    warc.write_archive(pages, path)
    got = {r["record_id"]: (r["record_type"], r["refers_to"], bytes(r["payload"]).decode()) for r in warc.read_records(spark, path).collect()}
    assert got[5] == ("response", None, LONG) and got[1] == ("revisit", 5, LONG)
