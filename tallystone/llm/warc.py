"""Content-addressed WARC archive: payloads once, exact record headers apart, records again by a join.

An archive is a folder of two Parquet tables. ``payloads(address, payload)`` has each distinct payload once under its
SHA-256. ``records(page_id, address, warc_header, http_header)`` has a row for each record with the exact bytes of its
header blocks. Of records with equal payloads of ``least_bytes`` or more, that with the greatest page_id is the
response and the others are revisits of it; records with smaller payloads are responses all.

The digest is verified: writing fails if one address has payloads of two lengths or SHA-1s; reading rebuilds the records and fails
if stored bytes don't have their address, or a record's bytes not its own length and digest. Payload bytes are shuffled
once to be written, after equal ones of a task have been reduced to one, and once to meet the headers of their
responses; revisits meet figures only. So neither a hot payload nor its copies meet in a task.

Null html is an empty payload. A null page_id is less than all others and yields no page field; a null url no target. A url is
kept exactly: a header can't hold line ends, so one that has some stands in ``X-Target-URI-Base64`` as well.
Of equal (page_id, url, payload) rows one is the response and the others revisit it. Extra columns are ignored. An
empty table gives an archive without records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm._shared import Scratch

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: five hex digits of it are four digits to the base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _clean(text: Column) -> Column:
    """A value can't hold line ends."""
    return F.regexp_replace(text, r"[\r\n]+", " ")


def _exact(text: Column) -> Column:
    """What ``_clean`` would alter, in base64."""
    return F.when(_clean(text) != text, F.base64(F.encode(text, "UTF-8")))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Writes one record for each row of ``pages(page_id, url, html)`` to the archive in ``folder``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    rows.select("address", "payload").dropDuplicates(["address"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")

    facts = rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))
    scratch = Scratch(pages.sparkSession, "warc-facts")
    rows = scratch.keep(facts, "facts").groupBy("page_id", "url", "address", "bytes", "digest").agg(F.count("*").alias("copies"))
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("p"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNotNull().alias("v"), "page_id", "url")
    by = rows.groupBy("address").agg(F.max(order).alias("top"), F.min(F.xxhash64("bytes", "digest")).alias("least"), F.max(F.xxhash64("bytes", "digest")).alias("most"))
    rows = rows.join(by, "address").withColumn("address", F.when(F.col("least") == F.col("most"), F.col("address")).otherwise(F.raise_error(F.concat(F.lit("two payloads have address "), "address"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    first = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url")) & (F.col("copy") == 1)
    rows = rows.withColumn("kind", F.when(first | (F.col("bytes") < least_bytes), "response").otherwise("revisit"))

    def record_id(page: Column, url: Column, copy: Column) -> Column:
        h = F.sha2(F.concat_ws("\n", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), F.col("address"), copy.cast("string")), 256)
        return F.concat(F.lit("<urn:uuid:"), *sum(([F.substring(h, a, n), F.lit(end)] for a, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))), []))

    revisit = F.col("kind") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes").cast("string"), F.lit(_END * 2))
    rows = rows.withColumn("http", http).withColumn("length", F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("bytes")))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _field("WARC-Type", F.col("kind")),
        _field("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        _field("WARC-Target-URI", _clean(F.col("url"))),
        _field("X-Target-URI-Base64", _exact(F.col("url"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Refers-To", F.when(revisit, record_id(F.col("top.page_id"), F.col("top.url"), F.lit(1)))),
        _field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _field("X-Page-ID", F.col("page_id").cast("string")),
        _field("X-Refers-To-Page-ID", F.when(revisit, F.col("top.page_id")).cast("string")),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", F.col("length").cast("string")),
        F.lit(_END),
    )
    rows.select("page_id", "address", header.cast("binary").alias("warc_header"), F.col("http").cast("binary").alias("http_header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")
    scratch.drop("facts")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.parquet(f"{folder}/payloads")
    right = F.sha2("payload", 256) == F.col("address")
    return found.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "address")).cast("binary")))


def _value(name: str) -> Column:
    """A header's field, null if it isn't there."""
    head = F.decode("warc_header", "UTF-8")
    return F.when(F.contains(head, F.lit(f"{_END}{name}: ")), F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, address, warc_header, record): the exact bytes of each record as it stands in a WARC file, put together again.

    A revisit has no payload, so it needs no join; responses meet theirs by address.
    """
    found = spark.read.parquet(f"{folder}/records")
    parts = [F.col("warc_header"), F.col("http_header"), F.col("payload"), F.lit(b"\r\n\r\n")]
    kind = _value("WARC-Type")
    responses = found.where(kind == "response").join(_payloads(spark, folder), "address", "left")
    responses = responses.withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), "address")).cast("binary")))
    revisits = found.where(kind == "revisit").withColumn("payload", F.lit(b""))
    return responses.select("page_id", "address", "warc_header", F.concat(*parts).alias("record")).union(revisits.select("page_id", "address", "warc_header", F.concat(*parts).alias("record")))


def payload_of(record: Column) -> Column:
    """The payload of a response record's bytes: what follows its two header blocks, without the record's end."""
    block = F.substring_index(F.decode(record, "ISO-8859-1"), _END * 2, 2)
    first = F.length(block) + 5  # one byte is one character there
    return F.substring(record, first, F.octet_length(record) - first - 3)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What the archive's rebuilt records say, held against their bytes.

    (page_id, url, record_id, record_type, refers_to, payload_bytes, payload_digest). Of each record Content-Length is
    held against its bytes; of responses digest and length are taken of the payload cut out of the record. The figures of a
    revisit are those of its response; they join by address, narrow.
    """
    rebuilt = records(spark, folder).select(
        "address", _value("X-Page-ID").cast("long").alias("page_id"), F.coalesce(F.decode(F.unbase64(_value("X-Target-URI-Base64")), "UTF-8"), _value("WARC-Target-URI")).alias("url"),
        _value("WARC-Record-ID").alias("record_id"), _value("WARC-Type").alias("record_type"), _value("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.substring_index(_value("WARC-Payload-Digest"), ":", -1).alias("own"), _value("Content-Length").cast("long").alias("length"),
        (F.octet_length("record") - F.octet_length("warc_header") - 4).cast("long").alias("bytes"),
        F.when(_value("WARC-Type") == "response", payload_of(F.col("record"))).alias("payload"),
    )
    rebuilt = rebuilt.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))}).drop("payload")
    scratch = Scratch(spark, "warc-read")
    rebuilt = scratch.keep(rebuilt, "rebuilt")
    facts = rebuilt.where("record_type = 'response'").groupBy("address").agg(F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d"))
    found = rebuilt.join(facts, "address", "left")
    which = F.coalesce("record_id", F.lit("?"))
    digest = F.coalesce("payload_digest", "d")
    digest = F.when(F.col("own") == digest, digest).otherwise(F.raise_error(F.concat(F.lit("record without its payload: "), which)))
    digest = F.when(F.col("length") == F.col("bytes"), digest).otherwise(F.raise_error(F.concat(F.lit("record of another length: "), which)))
    return found.select("page_id", "url", "record_id", "record_type", "refers_to", F.coalesce("payload_bytes", "b").alias("payload_bytes"), digest.alias("payload_digest"))
