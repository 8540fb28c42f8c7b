"""Content-addressed WARC archive.

Payload bytes are stored once by SHA-256; record headers are stored apart, exactly as the
WARC text has them, with the digest that leads to their payload. Reading joins headers to
payloads by digest (both are bucketed by it, so nothing moves), checks length, SHA-1 and SHA-256 of what comes back, and fails on any
difference. The query rebuilds every record so: its digest and length are of the rebuilt
payload, its id, type and reference are read from the stored header, and a header that is
malformed or does not fit its payload fails. Of records with equal payloads of at least `least` bytes the one with the
largest page_id is the response and the others are revisits that refer to it.

Line ends in a url are written as %0D and %0A, so that no url adds header lines.

Cases: null html is an empty payload; a null page_id is archived as it is; rows that repeat
a page_id give a record each, and those that hold the largest id of their group are all
responses; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelens.sources.shared import shared_dir

LEAST = 1000
#: Pages have no time of their own; an archive takes this one if none is given.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How a header starts.
HEADER = r"^WARC/1\.1\r\nWARC-Type: (?:response|revisit)\r\nWARC-Record-ID: "


@dataclass
class Archive:
    headers: DataFrame
    payloads: DataFrame


def bucketed(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder, bucketed by address: headers and payloads meet where they lie, so that no payload is shuffled to be read."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    name = f"warc_{path.rsplit('-', 1)[1]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "address").sortBy("address").saveAsTable(name)
    return spark.table(name)


def write_archive(pages: DataFrame, least: int = LEAST, date: str = DATE) -> Archive:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digests = rows.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    keepers = digests.groupBy("address").agg(F.max("page_id").alias("keeper"))
    typed = digests.join(keepers, "address").withColumn("revisit", F.coalesce((F.col("payload_bytes") >= least) & (F.col("page_id") != F.col("keeper")), F.lit(False)) | (F.col("page_id").isNull() & F.col("keeper").isNotNull() & (F.col("payload_bytes") >= least)))
    kind = F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    target = F.when(F.col("revisit"), F.col("keeper"))
    end = F.lit("\r\n")
    header = F.concat(
        F.lit("WARC/1.1"), end, F.lit("WARC-Type: "), kind, end,
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"), end,
        F.lit("WARC-Target-URI: "), F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), end,
        F.lit(f"WARC-Date: {date}"), end, F.lit("Content-Type: text/html"), end,
        F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}"), end)).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), end,
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"), end)).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"), end, end,
    )
    headers = bucketed(typed.select("page_id", "url", header.alias("header"), "address", "payload_digest", "payload_bytes", kind.alias("record_type"), target.alias("refers_to")))
    # one row of each address carries its bytes: the keeper's, or any if no id is known; the join's partitioning serves the dedup and the buckets
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    first = rows.select(F.sha2("payload", 256).alias("address"), key("page_id").alias("key"), "payload").join(keepers, "address").where(F.col("key") >= key("keeper"))  # the largest; an equality would be a key of the join, which deals rows by address alone
    payloads = bucketed(first.groupBy("address").agg(F.first("payload").alias("payload")))
    return Archive(headers, payloads)


def read_archive(archive: Archive) -> DataFrame:
    """Every record with its full payload: the columns of the headers and payload, all digests checked."""
    joined = archive.headers.join(archive.payloads.withColumnRenamed("address", "stored"), F.col("address") == F.col("stored"), "left")
    good = (F.sha2("payload", 256) == F.col("address")) & (F.sha1("payload") == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("binary"))
    return joined.select("page_id", "url", "header", "record_type", "refers_to", "payload_digest", "payload_bytes", checked.alias("payload"))


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id and the WARC record as bytes: header, payload (none for a revisit), two line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def read_digests(archive: Archive) -> DataFrame:
    """Every record without its payload: what read_archive checks is measured on each stored payload once, and only that is joined."""
    measured = archive.payloads.select(F.col("address").alias("stored"), (F.sha2("payload", 256) == F.col("address")).alias("whole"), F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    joined = archive.headers.join(measured, F.col("address") == F.col("stored"), "left")
    good = F.col("whole") & (F.col("digest") == F.col("payload_digest")) & (F.col("bytes") == F.col("payload_bytes"))
    digest = F.when(F.coalesce(good, F.lit(False)), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("string"))
    return joined.select("page_id", F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def described(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of rebuilt records: measured on the payload, read from the header."""
    digest, size = F.sha1("payload"), F.octet_length("payload").cast("long")
    field = lambda k: F.regexp_extract("header", k, 1)
    number = lambda c: F.when(c != "", c).cast("long")
    page, target = field(HEADER + r"<urn:page:(-?\d*)>\r\n"), field(r"\r\nWARC-Payload-Digest: sha1:[0-9a-f]{40}\r\nWARC-Refers-To: <urn:page:(-?\d+)>\r\nContent-Length: 0\r\n\r\n\z")
    kind = field(HEADER.replace("(?:", "("))
    length = F.when(kind == "revisit", F.lit(0)).otherwise(size)
    ends = F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), digest, F.lit("\r\n"), F.when(target != "", F.concat(F.lit("WARC-Refers-To: <urn:page:"), target, F.lit(">\r\n"))).otherwise(F.lit("")), F.lit("Content-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    good = (kind != "") & ((kind == "revisit") == (target != "")) & F.endswith("header", ends) & number(page).eqNullSafe(F.col("page_id"))
    checked = F.when(F.coalesce(good, F.lit(False)), kind).otherwise(F.raise_error(F.concat(F.lit("damaged header of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("string"))
    return records.select(number(page).alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), checked.alias("record_type"), number(target).alias("refers_to"))


def archived_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, as rebuilt from the archive."""
    return described(read_archive(write_archive(pages, least)))
