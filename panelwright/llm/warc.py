"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; record headers are stored exactly, apart from them; joins give the original records back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SALTS, looked_up, shared_dir, shuffles_freed

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records of one payload that a task takes at a time when they are read back; the payload is repeated for each part.
PART = 1000


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a hex digest of whole 40-bit groups, as SHA-1's: five hex digits are four base32 digits."""

    def four(i: int) -> list[Column]:
        n = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(ALPHABET), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[c for i in range(8) for c in four(i)])


def payload_digest(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """``payloads`` (content_id, parts, payload) and ``records`` (page_id, header, content_id, part) below ``path``.

    Among records with equal payloads of at least ``min_bytes`` the one with the smallest page_id is the response and the others revisit it; shorter ones
    are all responses. Null html is an empty payload. Null page_ids come last; a page_id that occurs twice with one payload gives one response, that of the first url, the
    other rows revisit it; rows equal in all are told apart by their place. An empty table gives an empty archive; other columns are not read; a very long payload is one value of its row. CR, LF and other controls in a url are percent-encoded, as a header line can't hold them; null urls are left out.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("content_id", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    row_order = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("i"), F.xxhash64("url").alias("u"), F.monotonically_increasing_id().alias("k"))
    records = base.select("page_id", "url", "content_id", "size", payload_digest(F.col("payload")).alias("sha1"), row_order.alias("o"))
    narrow = f"{path}/work"
    records.write.option("compression", "zstd").parquet(narrow)
    records = pages.sparkSession.read.parquet(narrow).withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(SALTS)).cast("int"))
    first = records.groupBy("content_id").agg(F.min("o").alias("first"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    joined = looked_up(records, "content_id", first)
    revisit = (F.col("size") >= min_bytes) & (F.col("o") != F.col("first"))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    blank = lambda c: F.coalesce(c, F.lit(""))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", record_id(F.col("page_id"))),
        blank(line("WARC-Target-URI", clean)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("first.i"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size"))), F.lit(CRLF),
    )
    part = F.pmod(F.xxhash64("o"), F.col("parts")).cast("int").alias("part")
    joined.select("page_id", header.cast("binary").alias("header"), "content_id", part).write.option("compression", "zstd").parquet(f"{path}/records")
    once = base.select("content_id", "payload").dropDuplicates(["content_id"])
    once.join(first.select("content_id", "parts").hint("merge"), "content_id").write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, header, content_id, payload, payload_ok``: every record with its full payload (a revisit's too), joined by digest.

    ``payload_ok`` recomputes the digest from the bytes read; a record whose payload is lost has a null payload.
    """
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("payload_ok", F.sha2("payload", 256) == F.col("content_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spark.read.parquet(f"{path}/records").join(payloads.hint("merge"), ["content_id", "part"], "left").select("page_id", "header", "content_id", "payload", "payload_ok")


def warc_bytes(records: DataFrame) -> DataFrame:
    """``page_id, record``: the bytes of each original WARC record; a revisit has no block of its own."""
    own = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat(F.col("header"), own, F.lit((CRLF * 2).encode())).alias("record"))


def field(header: Column, name: str) -> Column:
    """A header's value; null if it has none."""
    return F.nullif(F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def verified_digest(records: DataFrame) -> Column:
    """The payload's digest as its bytes give it; an error where these are lost, are not those of the content id, or differ from what the header says."""
    own = payload_digest(F.col("payload"))
    sound = F.col("payload_ok") & (field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), own))
    said = F.concat(F.lit("payload lost or damaged: content id "), F.coalesce("content_id", F.lit("none")))
    return F.when(F.coalesce(sound, F.lit(False)), own).otherwise(F.raise_error(said).cast("string"))


def digests(records: DataFrame) -> DataFrame:
    """What the headers say and the bytes are: ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Fails on a damaged or lost payload."""
    target = F.regexp_extract(F.coalesce(field(F.col("header"), "WARC-Refers-To"), F.lit("")), r"<urn:page:(.*)>", 1)
    typed = records.schema["page_id"].dataType
    return records.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), verified_digest(records).alias("payload_digest"),
        field(F.col("header"), "WARC-Type").alias("record_type"), F.when(~target.isin("", "none"), target).cast(typed).alias("refers_to"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """``pages`` written to a new archive in the shared folder, and its records read back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    with shuffles_freed(spark):
        write_archive(pages, path)
    return read_records(spark, path)
