"""Content-addressed WARC archive: payload bytes once per verified strong digest, exact record headers apart.

``write`` stores two tables below a folder: ``payloads`` (digest, payload), one row per distinct payload, and
``headers`` (every record with its exact header block and the digest of its payload). ``read`` rebuilds the original
records byte by byte through a join and checks each against its digest and length. ``write_files`` lays the records
out as WARC files.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest id is the response and the
others are revisits that refer to it. Payload bytes are dealt by digest with the first copy of every task only, and
the join back is between two plain shuffles, which adaptive execution splits where one payload has very many records.

Defined results: a null payload is empty. Null ids come last; of repeated rows with equal ids one is the response.
Null URLs give an empty target. Empty tables give empty archives. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT = 100
_END = "\r\n"
_DATE = "2024-01-01T00:00:00Z"


def _uuid(seed: Column) -> Column:
    h = F.sha2(seed.cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _header(record_type: Column) -> Column:
    """The exact header block, blank line included."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat(F.concat_ws(_END, F.lit("WARC/1.1"), field("WARC-Type", record_type), field("WARC-Record-ID", _uuid(F.concat_ws(" ", F.lit("record"), F.col("rid").cast("string")))),
                                field("WARC-Date", F.lit(_DATE)), field("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))),
                                field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
                                # concat_ws leaves out nulls: only revisits have these.
                                F.when(record_type == "revisit", field("WARC-Refers-To", _uuid(F.concat_ws(" ", F.lit("record"), F.col("first.rid").cast("string"))))),
                                F.when(record_type == "revisit", field("X-Refers-To-Id", F.coalesce(F.col("first.id").cast("string"), F.lit("")))),
                                field("Content-Type", F.lit("text/html; charset=utf-8")), field("Content-Length", F.col("size").cast("string"))), F.lit(_END + _END))


def write(pages: DataFrame, folder: str) -> None:
    """Archive ``pages`` (page_id, url, html) below ``folder``."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # Row numbers have to stay as they are for the record ids, so the small columns are kept first.
    rows.select(F.monotonically_increasing_id().alias("rid"), "id", "url", "digest", "size").write.option("compression", "zstd").parquet(f"{folder}/listed")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    listed = pages.sparkSession.read.parquet(f"{folder}/listed")
    first = listed.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    named = listed.join(first.drop("copies"), "digest", "left")
    kind = F.when(F.col("first").isNull() | (F.col("first.rid") == F.col("rid")), "response").otherwise("revisit")
    named.select("rid", "id", "digest", _header(kind).alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(rid, id, digest, header, record): the original bytes of every record, as in a file of responses only."""
    headers, payloads = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    body = F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.encode(F.lit(_END + _END), "UTF-8"))
    return headers.join(payloads, "digest").select("rid", "id", "digest", "header", body.alias("record"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload: parsed from the records' own bytes.

    A record whose bytes don't have the digest and length that its header names ends the job.
    """
    value = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    size = value("Content-Length").cast("long")
    start = F.octet_length(F.encode("header", "UTF-8"))
    parsed = records(spark, folder).select("id", "header", "record", size.alias("payload_bytes"), F.expr("substring(record, octet_length(encode(header, 'UTF-8')) + 1, octet_length(record) - octet_length(encode(header, 'UTF-8')) - 4)").alias("payload"))
    parsed = parsed.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("named", F.substring(value("WARC-Payload-Digest"), 8, 64))
    fits = (F.col("payload_digest") == F.col("named")) & (F.octet_length("payload") == F.col("payload_bytes")) & (F.octet_length("record") == start + F.col("payload_bytes") + 4)
    checked = F.when(fits, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record differs from its digest: "), "named")))
    return parsed.select(F.col("id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), value("WARC-Type").alias("record_type"),
                         F.when(value("WARC-Type") == "revisit", value("X-Refers-To-Id").try_cast("long")).alias("refers_to"), "payload")


def write_files(spark: SparkSession, folder: str, out: str, records_per_file: int = 10_000) -> None:
    """The archive as WARC files of whole records; a revisit has its header and no payload."""
    body = F.when(F.instr("header", "\r\nWARC-Type: revisit\r\n") > 0, F.concat(F.regexp_replace("header", r"Content-Length: \d+", "Content-Length: 0"), F.lit(_END + _END))).otherwise(F.decode("record", "UTF-8"))
    records(spark, folder).select(body.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(out)
