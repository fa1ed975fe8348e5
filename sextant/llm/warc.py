"""Content-addressed WARC archive (operator 9).

An archive is a folder of two tables. payloads holds the bytes of each distinct payload once, under
its SHA-256; headers holds the exact WARC header of each record with the address of its payload.
Reading joins the two, checks every payload against its address and every record's SHA-1 against
its header, and gives back the original records.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the largest id is the
response and the others revisit it; all smaller ones are responses. A null payload is empty. A null
id never is the largest; rows that repeat an id are records of their own, alike if their payloads are. A payload
may be as long as Spark's binary values (2 GB less a few bytes). A null address line is left out
and line ends inside an address become %0D and %0A. Extra columns of the input are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import scratch_path

MIN_REVISIT = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How a record's id stands in its header.
RECORD_URN = "urn:page:"


def _line(name: str, value: Column) -> Column:
    """One header line, nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _field(header: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def described(df: DataFrame, record_id: str, uri: str, payload: str) -> DataFrame:
    """record_id, uri, body, address (SHA-256), sha1 and n_bytes of each record."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary"))
    rows = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(uri).cast("string").alias("uri"), body.alias("body"))
    return rows.withColumns({"address": F.sha2("body", 256), "sha1": F.sha1("body"), "n_bytes": F.length("body").cast("long")})


def write_archive(df: DataFrame, path: str, record_id: str = "page_id", uri: str = "url", payload: str = "html", date: str = DATE) -> None:
    """Write the records of df under path (payloads and headers)."""
    rows = described(df, record_id, uri, payload)
    # any_value is aggregated before the shuffle: a payload leaves each task once however often it occurs
    rows.groupBy("address").agg(F.any_value("body").alias("body")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    heads = rows.drop("body")
    last = heads.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("address").agg(F.max("record_id").alias("last"), F.count(F.lit(1)).alias("n"))
    heads = heads.join(last.where("n > 1").drop("n"), "address", "left")
    revisit = F.col("last").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("last"))
    urn = lambda c: F.concat(F.lit(f"<{RECORD_URN}"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _line("WARC-Record-ID", urn(F.col("record_id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        _line("WARC-Target-URI", F.replace(F.replace("uri", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("last")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    heads.select(header.cast("binary").alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The exact headers with the fields parsed from them."""
    text = F.col("header").cast("string")
    number = lambda name: F.regexp_extract(text, rf"(?m)^{name}: <{RECORD_URN}(-?\d+)>", 1).try_cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        "header",
        "address",
        number("WARC-Record-ID").alias("record_id"),
        _field(text, "WARC-Type").alias("record_type"),
        _field(text, "WARC-Target-URI").alias("uri"),
        number("WARC-Refers-To").alias("refers_to"),
        F.substring_index(_field(text, "WARC-Payload-Digest"), ":", -1).alias("declared"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """address, body, sha1 and n_bytes of each payload; bytes that don't match their address are an error."""
    found = spark.read.parquet(f"{path}/payloads")
    body = F.when(F.sha2("body", 256) == F.col("address"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("address"))).cast("binary"))
    return found.select("address", body.alias("body")).withColumns({"sha1": F.sha1("body"), "n_bytes": F.length("body").cast("long")})


def _joined(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    out = heads.join(payloads, "address", "left")
    checked = F.when(F.col("sha1") == F.col("declared"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("no payload as declared: sha1:"), F.col("declared"))))
    return out.withColumn("sha1", checked)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: parsed fields, payload, and record (the exact bytes in a WARC file)."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("body"))
    out = _joined(read_headers(spark, path), read_payloads(spark, path))
    return out.select("record_id", "record_type", "uri", "refers_to", "n_bytes", "sha1", F.col("body").alias("payload"), F.concat(F.col("header"), block, F.lit(b"\r\n\r\n").cast("binary")).alias("record"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # length and digest are those of the payload that the record was rebuilt with
    return read_records(spark, path).select(F.col("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = """
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN strlen(body) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(body) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
