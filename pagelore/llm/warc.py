"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256, in a `payloads` table; the exact header bytes of
every record lie in a `headers` table. A record is rebuilt by joining the two on the digest. All of it is
DataFrame code. Who is the first of a digest is settled with digests and ids alone.

Defined results: a null payload is the empty payload; a page whose id is null is written as a response of
its own and is nobody's original; repeated page ids each get a record, and share the smallest id as their
original; a page with a null url has the target URI "urn:page:<page_id>"; an empty table gives an empty
archive. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import Scratch, delete_at_end, fresh_path, settings, written

#: Digits of base 32 as Java and Spark write them, and as RFC 4648 does.
DIGITS = "0123456789abcdefghijklmnopqrstuv"
RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Shuffle files go when the write that made them ends, instead of whenever the driver's garbage is next collected.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base 32 of a 40-digit hex string: five hex digits are four base-32 digits."""
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32)), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, RFC4648)


@dataclass(frozen=True)
class Archive:
    """Where an archive lies: its record headers and its payload store."""

    headers: str
    payloads: str


def describe(pages: DataFrame, *, min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, sha256, payload_digest, payload_bytes, record_type, refers_to: what each page's record is.

    Of the pages with one payload of at least min_bytes, that with the smallest id is the response. Only
    digests and ids move; the smallest id by digest is a partial aggregate, so a hot payload costs one row a task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").alias("url"),
        F.sha2(payload, 256).alias("sha256"),
        base32_of_hex(F.sha1(payload)).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    keep = scratch.written if scratch else written
    slim = keep(slim, "warc-digests")
    group = slim.where(F.col("payload_bytes") >= min_bytes).groupBy("sha256").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = keep(group.where("n > 1").drop("n"), "warc-repeats")  # read back, so that the join may split a hot digest
    revisit = F.col("first_id").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") > F.col("first_id"))
    return (
        slim.join(first, "sha256", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("first_id")
    )


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_text(date: str) -> Column:
    """The exact header block of a record, ending in an empty line. Control characters of a url become spaces."""
    uri = F.coalesce(F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", " "), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", path: str | None = None) -> Archive:
    """Write one record a page; each different payload is stored once. Returns where the archive lies.

    The headers table has header (exact bytes) and sha256, and nothing else: all that is read back comes
    from the header bytes. Payloads are made one a digest in each task before they are shuffled, so a payload
    that a third of the pages share moves once a task. These shuffled payloads are let go when the store
    is written, so that reading, which shuffles the payloads again, does not hold them twice. The store is compressed with zstd.
    """
    spark = pages.sparkSession
    root = path or fresh_path(spark, "warc")
    out = Archive(f"{root}/headers", f"{root}/payloads")
    if path is None:
        delete_at_end(spark, root)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    store = pages.select(payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256)).groupBy("sha256").agg(F.first("payload").alias("payload"))
    with settings(spark, TIDY):
        with Scratch(spark) as scratch:
            records = describe(pages, min_bytes=min_bytes, scratch=scratch)
            records.select(F.encode(header_text(date), "UTF-8").alias("header"), "sha256").write.parquet(out.headers)
        store.write.option("compression", "zstd").parquet(out.payloads)
    return out


def parsed_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, content_length, header, sha256, read from the header bytes."""
    text = F.decode(F.col("header"), "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(text, rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    ident = lambda name: F.nullif(F.regexp_extract(text, rf"\n{name}: <urn:page:(-?[0-9]+)>\r\n", 1), F.lit("")).cast("long")
    return spark.read.schema("header binary, sha256 string").parquet(archive.headers).select(
        ident("WARC-Record-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        ident("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        field("Content-Length").cast("long").alias("content_length"),
        "header",
        "sha256",
    )


def verified_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """sha256, payload of the store; bytes that don't give their own key raise an error."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(archive.payloads)
    wrong = F.raise_error(F.concat(F.lit("payload fails its digest: "), F.col("sha256")))
    return stored.select(F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(wrong).alias("sha256"), "payload")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records with their payloads, and `record`: the original bytes, header + block + two line ends.

    Both sides of the join are shuffled by digest, where a hot digest's headers can be split; each meets one stored payload.
    """
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return (
        parsed_headers(spark, archive)
        .join(verified_payloads(spark, archive), "sha256")
        .withColumn("record", F.concat(F.col("header"), block, F.encode(F.lit(CRLF + CRLF), "UTF-8")))
    )


def read_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from rebuilt records.

    A response's payload is cut out of the record's own bytes, behind the empty line, as long as its header says; a
    revisit's is that of the record it refers to. A record that disagrees with its own header raises an error.
    """
    revisit = F.col("record_type") == "revisit"
    behind = F.octet_length("header")
    own = F.substring(F.col("record"), behind + 1, F.col("content_length").cast("int"))
    payload = F.when(revisit, F.col("payload")).otherwise(own)
    ends = F.substring(F.col("record"), (behind + F.col("content_length") + 1).cast("int"), F.lit(1 << 30)) == F.encode(F.lit(CRLF + CRLF), "UTF-8")
    seen = records.select("page_id", payload.alias("payload"), ends.alias("ends"), "payload_digest", "record_type", "refers_to")
    digest = base32_of_hex(F.sha1("payload"))
    agreed = F.when(F.col("ends") & (digest == F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record disagrees with its header")))
    return seen.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), agreed.alias("payload_digest"), "record_type", "refers_to")
