"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header of every
record is kept apart; records come back by a join of the two, and each payload
is held against its address and its header's digest when it is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """The SHA-1 in upper-case base32, ten hex digits (40 bits) at a time."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


@dataclass
class Archive:
    """Two tables: ``payloads`` (address, payload) and ``headers`` (page_id, address, header)."""

    payloads: DataFrame
    headers: DataFrame


def _record_id(page_id, url, copy):
    """Unique for each record: the page, then a digest of its url, payload and which copy it is."""
    own = F.sha1(F.concat_ws(" ", F.col("address"), copy.cast("string"), url))
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), own, F.lit(">"))


def write_archive(pages: DataFrame, least_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """One record per row of ``pages`` (page_id, url, html), payload the html in UTF-8.

    Of records with equal payloads of at least ``least_revisit_bytes`` bytes the
    one with the largest page_id is the response and the others revisit it;
    smaller payloads are responses all. A null html is an empty payload, a null
    url leaves its header line out, control characters and blanks of a url are
    written as %XX, a null page_id is smaller than any other. Of rows that repeat in
    page_id and payload the one with the largest url responds, each a record of its own
    with an id of its own. ``date`` is the capture time of all, as the table has none.
    Other columns are ignored; an empty table gives an empty archive.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").alias("bytes")
    )
    # Copies become one row in each task before anything is shuffled.
    payloads = written(rows.groupBy("address").agg(F.first("payload").alias("payload")), "warc-payloads")
    narrow = rows.select("page_id", "url", "address", "sha1", "bytes").groupBy("page_id", "url", "address", "sha1", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    leaders = written(rows.groupBy(F.col("address").alias("_address")).agg(F.max(F.struct("page_id", "url")).alias("leader")), "warc-leaders")
    records = narrow.join(leaders, F.col("address") == F.col("_address")).select(*narrow.columns, F.col("leader.page_id").alias("leader"), F.col("leader.url").alias("leader_url"))
    records = records.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    leads = F.col("page_id").eqNullSafe(F.col("leader")) & F.col("url").eqNullSafe(F.col("leader_url")) & (F.col("copy") == 1)
    responds = leads | (F.col("bytes") < least_revisit_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.col("url")
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(responds, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(responds, F.lit("")).otherwise(
            F.concat(line("WARC-Refers-To", _record_id(F.col("leader"), F.col("leader_url"), F.lit(1))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
        ),
        line("Content-Length", F.when(responds, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )
    headers = written(records.select("page_id", "address", header.alias("header")), "warc-headers")
    return Archive(payloads, headers)


def read_archive(archive: Archive) -> DataFrame:
    """The records again: type, ids and digest as the header says, and the payload.

    A payload that does not have the SHA-256 it is stored under, or the SHA-1 that
    a header names, stops the query. A revisit gets the payload it refers to;
    ``record`` holds a record's exact bytes as they stand in a WARC file.
    """
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?[0-9]+):[0-9a-f]{40}>$", 1)
    stored = archive.payloads.withColumn("_sha1", base32_sha1(F.col("payload"))).where(
        F.assert_true(F.sha2("payload", 256) == F.col("address"), "a payload does not match its address").isNull()
    )
    joined = archive.headers.drop("page_id").join(stored.withColumnRenamed("address", "_address"), F.col("address") == F.col("_address"), "left")
    joined = joined.where(F.assert_true((F.concat(F.lit("sha1:"), F.col("_sha1")) == field("WARC-Payload-Digest")), "a payload is missing or does not match its header").isNull())
    kind = field("WARC-Type")
    block = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(
        F.nullif(page("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        kind.alias("record_type"),
        F.nullif(page("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"),
        F.substring(field("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        "payload",
        F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"),
    )


def save_archive(archive: Archive, path: str) -> None:
    archive.payloads.write.mode("overwrite").parquet(f"{path}/payloads")
    archive.headers.write.mode("overwrite").parquet(f"{path}/headers")


def load_archive(spark: SparkSession, path: str) -> Archive:
    return Archive(spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/headers"))


__all__ = ["Archive", "base32_sha1", "load_archive", "read_archive", "save_archive", "write_archive"]
