"""Content-addressed WARC archive.

``write_archive`` stores each distinct payload once, under its SHA-256, and the exact WARC header
block of every record separately; ``read_archive`` joins them back into whole records and checks
each payload against both of its digests. Everything is DataFrame code; the archive is two Parquet
tables, so any executor can read any part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentide.llm.scratch import discard, write_table, written

CRLF = "\r\n"
#: Digit alphabets of conv() and of base32 (RFC 4648); fixed values.
_BASE_32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each 20 bits (five hex digits) become four characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _BASE_32_DIGITS, _BASE32_ALPHABET)


def _record_id(page: Column) -> Column:
    """A urn:uuid made of the page id's MD5, equal in every run."""
    h = F.md5(F.concat(F.lit("record:"), F.coalesce(page.cast("string"), F.lit(""))))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(fields: list[tuple[str, Column]]) -> Column:
    """The header block with its closing blank line; a null field leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in fields]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(CRLF))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write ``path``/headers (one row per record) and ``path``/payloads (one per distinct payload).

    Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the smallest
    id is the response and the others revisit it; of smaller payloads all are responses.

    Cases: null html is an empty payload; null url leaves WARC-Target-URI out; line breaks in a
    url are escaped as %0D and %0A. Rows that repeat the smallest id of a payload are all
    responses. Ids are of any type that a line of a header can hold; record ids follow from them, so
    rows with equal ids, or none, share one. Null ids come after all others; a payload that only rows with null ids hold has
    responses only. Payloads of any length are kept whole. No rows give two empty tables. Other columns are ignored.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"address": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload").cast("long")})
    marks = written(rows.select("id", "url", "address", "bytes", base32_sha1(F.col("payload")).alias("sha1")), "warc-marks")
    first = written(marks.groupBy("address").agg(F.min("id").alias("first_id")), "warc-first")
    known = marks.join(first, "address")
    revisit = (F.col("bytes") >= revisit_bytes) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisit, "revisit").otherwise("response")
    header = _header(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", _record_id(F.col("id"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id")))),
            ("X-Page-ID", F.col("id")),
            ("X-Refers-To-Page-ID", F.when(revisit, F.col("first_id"))),
            ("X-Payload-Length", F.col("bytes")),
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
        ]
    )
    write_table(known.select("id", "address", header.cast("binary").alias("header")), f"{path}/headers")

    # The payload goes along once: only the row that first holds it is joined with its bytes.
    named = {"__id": F.coalesce(F.col("id").cast("string"), F.lit("")), "__null": F.col("id").isNull()}
    keepers = first.withColumnRenamed("first_id", "id").withColumns(named).select("__id", "__null", "address")
    stored = rows.withColumns(named).join(keepers, ["__id", "__null", "address"], "left_semi").dropDuplicates(["__id", "__null", "address"])
    write_table(stored.select("address", "bytes", "payload"), f"{path}/payloads")
    discard(marks)
    discard(first)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: ``id``, ``record`` (exact bytes), ``payload`` (full, revisits too) and the
    fields read back from the header, with ``verified`` telling that the payload's SHA-256 is its
    address and its SHA-1 the one that the header names."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads")
    text = F.decode("header", "UTF-8")
    kind = headers.schema["id"].dataType

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, f"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))

    parsed = headers.select(
        "id",
        "address",
        "header",
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("__named_digest"),
        field("X-Page-ID").cast(kind).alias("page_id"),
        field("X-Refers-To-Page-ID").cast(kind).alias("refers_to"),
        field("X-Payload-Length").cast("long").alias("__named_bytes"),
    )
    checked = payloads.select(
        "address",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        (F.unhex(F.sha2("payload", 256)) == F.col("address")).alias("__addressed"),
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    same = (F.col("payload_digest") == F.col("__named_digest")) & (F.col("payload_bytes") == F.col("__named_bytes"))
    return parsed.join(checked, "address").select(
        "id",
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload_digest",
        "payload_bytes",
        F.concat("header", body, F.lit((CRLF * 2).encode())).alias("record"),
        "payload",
        (F.col("__addressed") & same).alias("verified"),
    )
