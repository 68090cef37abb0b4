"""A content-addressed WARC archive: payloads once by SHA-256, exact record headers apart, records rebuilt through joins.

The archive is two Parquet tables in one folder. `payloads` (digest, payload) has each distinct payload once; `headers`
(page_id, digest, header) has the full header block of every record. A record is header, blank line, block and two line ends; the
block of a response is its payload, that of a revisit is empty.
Only digests and ids meet in the joins that choose responses; the payload moves once for writing, combined before it
moves, and once where records are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.common import Scratch, file_count, lean

EOL = "\r\n"
#: Fixed value: what a revisit's record says of its payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_of(html: Column) -> Column:
    return F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row into the archive folder at `path`.

    Of the records whose payloads are equal and have at least `least` bytes, that of the smallest id is the response and
    the others are revisits that refer to it; shorter payloads are all responses. Null html is an empty payload, a null
    url an empty target; line ends in urls are percent-encoded in the header, which keeps it one line. A null id counts
    as larger than all others. Of rows that repeat an id, the response is that of the smallest url; rows equal to the
    response in all three columns are responses too. Columns beyond these three are not archived. date: the WARC-Date of the
    records. Payloads of one digest must agree in length and two more hashes, or the write fails. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    body = payload_of(F.col(html))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("bytes"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    # the response of each long payload that is there again: one small row per digest, combined before it moves
    first = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # written, so that both sides of the join are plain shuffles, whose hot digests can be split; short payloads stay out of it
    first = Scratch(spark, "warc-first", pages).keep(first, "first")
    short = rows.where(F.col("bytes") < least).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
    chosen = rows.where(F.col("bytes") >= least).join(first, "digest", "left").select(short.columns).unionByName(short)
    kind = F.when(F.col("first").isNull() | (rank == F.col("first")), F.lit("response")).otherwise(F.lit("revisit"))
    target = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit(EOL))
    again = F.col("type") == "revisit"
    header = F.concat(
        F.lit("WARC/1.1" + EOL), line("WARC-Type", F.col("type")), line("WARC-Record-ID", named(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", named(F.col("first.page_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    headers = chosen.withColumn("type", kind).select("page_id", "digest", header.alias("header"))
    with lean(spark):
        headers.coalesce(file_count(pages)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")
        stored = pages.select(body.alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload", F.struct(F.length("payload"), F.xxhash64("payload"), F.crc32("payload")).alias("check"))
        stored = stored.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("check").alias("low"), F.max("check").alias("high"))
        stored = stored.select("digest", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads of digest "), "digest")).cast("binary")).alias("payload"))
        stored.coalesce(file_count(pages)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """digest, header, record (header, blank line, block, two line ends) and the stored payload of every record of an archive."""
    headers = spark.read.parquet(f"{path}/headers").withColumn("header", F.encode("header", "UTF-8"))
    block = F.when(F.expr("decode(header, 'UTF-8')").contains(f"{EOL}WARC-Type: revisit{EOL}"), F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat(F.col("header"), F.lit(EOL.encode()), block, F.lit((EOL * 2).encode()))
    return headers.join(spark.read.parquet(f"{path}/payloads"), "digest").select("digest", "header", record.alias("record"), "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild every record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload, header, intact.

    All is parsed from the rebuilt record's own bytes, but for the payload of revisits, which is that of their digest. intact:
    the payload has the header's digest, and the record the header's length, checked on the bytes that came back. An empty
    archive gives no rows.
    """
    record = rebuilt(spark, path).withColumn("head", F.decode("header", "UTF-8"))
    field = lambda key, what: F.regexp_extract(F.col("head"), rf"\r\n{key}: {what}\r\n", 1)
    named = lambda key: F.regexp_extract(F.col("head"), rf"\r\n{key}: <urn:page:(-?\d*)>\r\n", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    size = F.length("header")
    out = record.withColumns({"type": field("WARC-Type", "(.*)"), "size": field("Content-Length", r"(\d+)").cast("long"), "named": field("WARC-Payload-Digest", "sha256:(.*)")})
    own = F.when(F.col("type") == "revisit", F.col("payload")).otherwise(F.expr("substring(record, length(header) + 3, cast(size as int))"))
    out = out.withColumn("payload", own)
    intact = (F.sha2("payload", 256) == F.col("named")) & (F.length("record") == size + F.col("size") + 3 * len(EOL))
    return out.select(
        number(named("WARC-Record-ID")).alias("page_id"), field("WARC-Target-URI", "(.*)").alias("url"), F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", number(named("WARC-Refers-To"))).alias("refers_to"), F.col("named").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"), "payload", F.col("head").alias("header"), intact.alias("intact"),
    )


def write_warc_files(spark: SparkSession, archive: str, path: str) -> None:
    """Plain .warc files of the archive's records as they were stored, headers byte by byte and revisits without payload. Payloads are UTF-8, as write_archive makes them; a record's last two line ends are the text writer's. An empty archive gives no records."""
    record = F.expr("decode(substring(record, 1, length(record) - 4), 'UTF-8')")
    rebuilt(spark, archive).select(record.alias("value")).write.option("lineSep", EOL * 2).text(path)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archive the pages in the shared folder and read them back."""
    spark = pages.sparkSession
    at = Scratch(spark, "warc").root
    write_archive(pages, at, **options)
    return read_archive(spark, at)
