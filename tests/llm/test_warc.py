"""The archive: round trip, dedup rule, and the errors it must raise."""

import hashlib

import pytest

from sextant.llm import warc
from sextant.llm._runtime import scratch_path

BIG = "x" * 1000


def rows_of(spark, data, schema="page_id long, url string, html string"):
    path = scratch_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame(data, schema), path)
    return path


def test_rule_and_round_trip(spark):
    data = [(1, "http://a", BIG), (5, "http://b", BIG), (3, None, BIG), (7, "http://c", "small"), (8, "http://d", "small"), (9, "u\r\nX: y", None), (10, "http://é", ""), (11, "e", "é" * 500)]
    path = rows_of(spark, data)
    got = {r["record_id"]: r for r in warc.read_records(spark, path).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None), 10: ("response", None), 11: ("response", None)}
    for i, url, html in data:
        body = (html or "").encode()
        assert bytes(got[i]["payload"]) == body and got[i]["sha1"] == hashlib.sha1(body).hexdigest() and got[i]["n_bytes"] == len(body)
        record = bytes(got[i]["record"])
        head, _, block = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block == (b"" if got[i]["record_type"] == "revisit" else body) + b"\r\n\r\n"
        assert f"Content-Length: {len(block) - 4}".encode() in head.split(b"\r\n")
        assert got[i]["uri"] == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)
    assert spark.read.parquet(f"{path}/payloads").count() == 4


def test_null_and_repeated_ids(spark):
    path = rows_of(spark, [(None, "a", BIG), (4, "b", BIG), (4, "b", BIG)])
    got = sorted((str(r["record_id"]), r["record_type"], r["refers_to"]) for r in warc.read_records(spark, path).collect())
    assert got == [("4", "response", None), ("4", "response", None), ("None", "revisit", 4)]


def test_empty_table_and_extra_columns(spark):
    path = rows_of(spark, [], "page_id long, url string, html string, address string, body string, header string")
    assert warc.read_records(spark, path).collect() == []
    path = rows_of(spark, [(1, "a", BIG, "k", "k", "k")], "page_id long, url string, html string, address string, body string, header string")
    assert warc.read_records(spark, path).count() == 1


def test_a_changed_payload_is_an_error(spark):
    path = rows_of(spark, [(1, "a", BIG)])
    bad = scratch_path(spark, "test-warc")
    spark.read.parquet(f"{path}/payloads").selectExpr("address", "cast('other' as binary) AS body").write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(spark, bad).collect()
