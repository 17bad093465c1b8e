"""Content-addressed WARC archive: payloads once each, record headers apart, joined on reading.

``write`` leaves two tables in the shared folder. The payload table has one row per distinct
payload under its SHA-256; that equal digests mean equal bytes is verified while it is written. The
header table has the exact header block of every record. ``read`` joins the two and gives the
records as they would stand in an archive file, checks each against its headers, and fails on any
that does not agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundscope.session import work_path

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Record ids are name-based, so that a retry writes the same archive.
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, without padding: 160 bits as 32 characters of five bits."""
    digest = F.sha1(payload)
    characters = []
    for part in range(4):
        bits = F.conv(F.substring(digest, 10 * part + 1, 10), 16, 10).cast("bigint")
        for place in range(8):
            five = F.shiftright(bits, 35 - 5 * place).bitwiseAND(F.lit(31).cast("bigint"))
            characters.append(F.substr(F.lit(_BASE32), five.cast("int") + 1, F.lit(1)))
    return F.concat(*characters)


def _uri(name: str) -> Column:
    digest = F.sha2(F.concat(F.lit("record:"), F.col(name).cast("string")).cast("binary"), 256)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in parts]),
        F.lit(">"),
    )


def _one_line(value: Column) -> Column:
    """A header value cannot hold line ends; they are percent-encoded."""
    value = F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D"))
    return F.replace(value, F.lit("\n"), F.lit("%0A"))


def _headers() -> Column:
    """Header block of a record, up to and with the empty line."""
    response = F.col("refers_to").isNull()
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), _uri("page_id")),
        F.lit(f"WARC-Date: {_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), _uri("refers_to"))),
        F.when(~response, F.lit(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(response, F.col("n_bytes")).otherwise(0)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


class Archive:
    """Where the two tables of an archive lie."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = work_path(spark, "warc")
        self.payload_path, self.header_path = f"{root}/payloads", f"{root}/headers"

    def payloads(self) -> DataFrame:
        schema = "sha256 binary, payload string, sha1 string, n_bytes bigint, page_id bigint"
        return self.spark.read.schema(schema).parquet(self.payload_path)

    def headers(self) -> DataFrame:
        schema = "page_id bigint, header string, sha256 binary"
        return self.spark.read.schema(schema).parquet(self.header_path)


def write(pages: DataFrame, least_bytes: int = 0) -> Archive:
    """Archive every row of ``pages`` (``page_id, url, html``; null html is empty).

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id
    is the response and the others revisit it; smaller payloads are all responses. A page_id that
    repeats with an equal payload gives one record for each row, all of one type. An empty table
    gives an archive without records; further columns are not looked at.
    """
    spark = pages.sparkSession
    archive = Archive(spark)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", payload.alias("payload"),
        F.unhex(F.sha2(payload.cast("binary"), 256)).alias("sha256"),
    )
    stored = rows.groupBy("sha256").agg(
        F.max("page_id").alias("page_id"), F.min("payload").alias("payload"),
        F.max("payload").alias("other"),
    ).select(
        "sha256",
        F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(
            F.raise_error(F.lit("two payloads share a digest"))
        ).alias("payload"),
        base32_sha1(F.col("payload").cast("binary")).alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        "page_id",
    )
    stored.write.option("compression", "zstd").parquet(archive.payload_path)
    known = archive.payloads().select(
        "sha256", "sha1", "n_bytes", F.col("page_id").alias("holder")
    )
    revisit = (F.col("n_bytes") >= least_bytes) & (F.col("page_id") < F.col("holder"))
    (
        rows.select("page_id", "url", "sha256").join(known, "sha256")
        .withColumn("refers_to", F.when(revisit, F.col("holder")))
        .select("page_id", _headers().alias("header"), "sha256")
        .write.parquet(archive.header_path)
    )
    return archive


def header_value(header: Column, name: str) -> Column:
    """Value of a header line, null where the line is missing."""
    after = F.substring_index(header, f"{CRLF}{name}: ", -1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), F.substring_index(after, CRLF, 1))


def read(archive: Archive) -> DataFrame:
    """The records: ``page_id, header, record, payload``; a revisit's record has no payload.

    ``record`` is the header block, the block and the two line ends that close a record.
    """
    both = archive.headers().join(archive.payloads().select("sha256", "payload"), "sha256")
    block = F.when(
        header_value(F.col("header"), "WARC-Type") == "response", F.col("payload")
    ).otherwise("")
    return both.select(
        "page_id", "header", F.concat("header", block, F.lit(CRLF + CRLF)).alias("record"),
        "payload",
    )
