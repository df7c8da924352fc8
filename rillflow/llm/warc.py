"""Content-addressed archive of WARC records: payloads once, headers apart, records by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

CRLF = "\r\n"


def base32(hex_digest: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hex string whose length is a multiple of five."""
    part = lambda i: F.lpad(F.conv(F.substring(hex_digest, i, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(1, digits, 5)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _occurrence(rows: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Adds occurrence, from 0, among rows equal in ``keys``: numbered inside each value of ``salt``, whose counts are added up, so that many equal rows are many tasks' work."""
    counts = rows.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = written(counts.withColumn("before", before).where("n > 1 or before > 0").select(*[F.col(k).alias(f"k_{k}") for k in keys], F.col(salt).alias("k_salt"), "before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys], F.col(salt) == F.col("k_salt"))
    inside = F.row_number().over(Window.partitionBy(*keys, salt).orderBy("rid")) - 1
    both = rows.join(many, same, "left")
    alone = both.where("before is null").withColumn("occurrence", F.lit(0).cast("long"))
    several = both.where("before is not null").withColumn("occurrence", (F.col("before") + inside).cast("long"))
    return alone.unionByName(several).drop(*many.columns)


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as ``path/headers`` (one exact record header a page) and ``path/payloads`` (each distinct payload once).

    Payloads are named by SHA-256, and equal names must agree in SHA-1 and length, else the job fails. Of equal payloads of at
    least ``least_bytes`` bytes, the one with the largest page_id (of tied rows the one with the greatest record id) is a response and the
    others revisit it; smaller ones are all responses. A record id is made of page_id, MD5 of url and payload digest, and a number among rows equal in these, so headers
    don't depend on how the input is partitioned. ``date`` is the WARC-Date of all records, as the pages have no time of their own.

    A null html is an empty payload, a null url an empty
    target; page_id may be null (smallest) or repeated; other columns are ignored; very long pages are payloads like others; an empty table gives an archive without records. Groups are found by grouped maxima and
    a join of narrow rows, which splits where one payload has a large share of them; payloads are reduced to one of each kind in every partition, and then shuffled once.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", url.alias("url"), F.monotonically_increasing_id().alias("rid"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    rows = written(rows.withColumns({"salt": F.shiftright("rid", 33), "name": F.md5(F.concat("url", F.lit(" "), "sha256"))}))
    rows = written(_occurrence(rows, ["page_id", "name"], "salt").withColumn("own", F.struct("page_id", "name", "occurrence")))
    groups = rows.groupBy("sha256").agg(F.max("own").alias("owner"), F.min("sha1").alias("low"), F.max("sha1").alias("high"), F.min("bytes").alias("least"), F.max("bytes").alias("bytes"))
    same = (F.col("low") == F.col("high")) & (F.col("least") == F.col("bytes"))
    groups = written(groups.select("sha256", "owner", F.when(same, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("one digest, two payloads: "), "sha256")).cast("long")).alias("size")))
    joined = rows.join(groups, "sha256")
    revisit = ~F.col("own").eqNullSafe(F.col("owner")) & (F.col("size") >= least_bytes)
    urn = lambda s: F.concat(F.lit("<urn:rillflow:"), F.coalesce(F.col(f"{s}.page_id").cast("string"), F.lit("null")), F.lit(":"), F.col(f"{s}.name"), F.lit(":"), F.col(f"{s}.occurrence").cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn("own")),
        F.lit(f"WARC-Date: {date}"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("owner"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "%0A")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    joined.select("page_id", F.encode(header, "UTF-8").alias("header"), "sha256").write.parquet(f"{path}/headers")
    named = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload"))
    named.groupBy("sha256").agg(F.min("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, header and record (the exact bytes: header, block, two line ends), payload (of a revisit that of the record it refers to).

    Every payload is checked against its name; a missing or altered one fails the job.
    """
    heads, held = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    both = heads.join(held, "sha256", "left")
    whole = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or altered: "), "sha256")).cast("binary"))
    both = both.select("page_id", "header", F.decode("header", "UTF-8").alias("head"), whole.alias("payload"))
    block = F.when(header_field("head", "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select("page_id", "head", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def header_field(head: str, name: str) -> Column:
    """A field of a record's header; null where it has none."""
    found = F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(found != "", found)


def archive_roundtrip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write an archive to the shared folder and read its records back."""
    path = shared_dir(pages.sparkSession)
    write_archive(pages, path, least_bytes)
    return read_records(pages.sparkSession, path)
