"""Content-addressed web archive: payload bytes once per digest, exact record headers apart, records by a join.

An archive is a folder with two tables. ``payloads`` holds every different payload once under its SHA-256; ``headers``
holds one row per record with the exact header block of its WARC record. Reading recomputes both digests from the stored
bytes and fails on a payload that does not match its key, so a damaged archive is never read silently.

A record whose payload is at least ``revisit_from`` bytes and equals that of a record with a smaller id is a ``revisit``
of the smallest such id; its record has headers only. Everything else is a ``response``.

Defined results: NULL html is an empty payload; a NULL id sorts after all others, so it is a response only if no other
record has its payload; of rows with the same id and payload (repeated rows) one is the response; NULL urls are empty;
an empty table gives an empty archive; further input columns are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 base32 characters; 160 bits are eight groups of 20, so no padding."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), HEX, BASE32)


CRLF = "\r\n"


def header(record_type: Column, page_id: Column, url: Column, sha1: Column, sha256: Column, refers_to: Column, length: Column) -> Column:
    """The header block of a WARC record, up to and with the empty line."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    clean = lambda c: F.regexp_replace(c, r"[\r\n]", "%0A")
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), record_type,
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), text(page_id),
        F.lit(f">{CRLF}WARC-Target-URI: "), clean(url),
        F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Payload-Digest: sha1:"), sha1,
        F.lit(f"{CRLF}X-Payload-SHA256: "), sha256,
        F.when(record_type == "revisit", F.concat(F.lit(f"{CRLF}WARC-Refers-To: <urn:page:"), text(refers_to), F.lit(f">{CRLF}WARC-Profile: {profile}"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.when(record_type == "revisit", F.lit(0)).otherwise(length).cast("string"),
        F.lit(f"{CRLF}{CRLF}"),
    )


def record_headers(rows: DataFrame, revisit_from: int = 0) -> DataFrame:
    """``sha256`` and ``header`` of every record, from rows without payloads.

    Equal rows are counted first. The first record of a digest comes from an aggregation that combines before the
    shuffle; a payload that a third of all pages share is many small rows of one key in a join that Spark can split.
    """
    counted = rows.groupBy("page_id", "url", "sha256", "sha1", "payload_bytes").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    first = counted.groupBy("sha256").agg(F.min(order).alias("first"))
    copies = counted.join(first, "sha256").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url")) & (F.col("copy") == 1)
    kind = F.when(is_first | (F.col("payload_bytes") < revisit_from), "response").otherwise("revisit")
    typed = copies.withColumn("record_type", kind)
    cols = [F.col(c) for c in ("record_type", "page_id", "url", "sha1", "sha256", "first.page_id", "payload_bytes")]
    return typed.select("sha256", header(*cols).alias("header"))


def write_archive(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write ``<path>/payloads`` and ``<path>/headers``."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    once = rows.groupBy("sha256").agg(F.any_value("payload").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    digests = rows.select("page_id", "url", "sha256", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    record_headers(digests, revisit_from).write.option("compression", "zstd").parquet(f"{path}/headers")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``sha256``, ``payload``; a payload whose bytes do not give its key ends the query with an error."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    broken = F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")
    return stored.select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(broken).alias("payload"))


def parsed_headers(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The fields of every stored header block, with the block itself."""
    heads = spark.read.schema("sha256 string, header string").parquet(f"{path}/headers")
    field = lambda name, value="([^\r\n]*)": F.regexp_extract("header", f"\r\n{name}: {value}\r\n", 1)
    page = lambda name: F.nullif(field(name, "<urn:page:([^>]*)>"), F.lit("")).try_cast(id_type)
    return heads.select(
        "sha256", "header", page("WARC-Record-ID").alias("page_id"), field("WARC-Target-URI").alias("url"), field("WARC-Type").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("header_sha1"), page("WARC-Refers-To").alias("refers_to"),
    )


def read_records(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Every record's fields, with size and digest of the payload that it was rebuilt with."""
    digest = base32_sha1(F.col("payload"))
    return reconstruct(spark, path, id_type).select(
        "page_id", "url", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "sha256",
        (F.col("header_sha1") == digest).alias("digest_matches"),
    )


def reconstruct(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Every record as the bytes of its WARC record (``record``), with the payload it stands for (``payload``)."""
    whole = parsed_headers(spark, path, id_type).join(verified_payloads(spark, path), "sha256")
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.select("page_id", "url", "record_type", "refers_to", "sha256", "header_sha1", "payload", F.concat(F.encode("header", "UTF-8"), block, end).alias("record"))
