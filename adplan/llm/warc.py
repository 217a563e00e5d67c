"""WARC archives: writing captures, reading records back, and assembling transactions."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adplan.llm.common import shared_folder

#: Payloads from this length on are stored once; later records of them are revisits.
REVISIT_BYTES = 1000
#: Captures in one archive, at most.
CAPTURES_PER_FILE = 2000

_RECORD = ("record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
           "payload_digest string, payload_bytes long, fields map<string,string>, payload string")


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Text of one record but for the two line ends behind it; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def plan_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html (never null), digest, bytes, refers_to (page_id or null), copy.

    Of equal payloads of REVISIT_BYTES or more the largest page_id is kept and the others refer
    to it; rows that repeat that page_id with the same payload are kept too. copy numbers
    rows of one page_id and payload. Null urls become empty. A null page_id never is referred
    to unless all rows of the payload have none, and then nothing refers to it.
    """
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    # Digests alone are grouped; partial aggregates make a payload of many pages cheap.
    kept = base.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("target"), F.min("page_id").alias("least"), F.count("*").alias("n"))
    links = (base.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest")
             .join(kept.where("n > 1 and target is not null"), "digest")
             .where("page_id is null or page_id < target")
             .groupBy("page_id", "digest").agg(F.max("target").alias("refers_to")))
    # Join and numbering share one key without nulls, so pages move once.
    key = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest").alias("key")
    linked = base.select("*", key).join(links.select(key, "refers_to"), "key", "left")
    return linked.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("url")) - 1).drop("key")


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes three records per row of pages: response (or revisit), request, metadata, gzipped.

    The text writer puts the two line ends that close each record; payloads are the html in UTF-8.
    """
    name = lambda kind: F.concat_ws(":", F.lit(f"<urn:{kind}"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest", F.concat(F.col("copy").cast("string"), F.lit(">")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    own, again = name("capture"), F.col("refers_to").isNotNull()
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))]
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    capture = _record(
        [("WARC-Type", F.when(again, "revisit").otherwise("response")), ("WARC-Record-ID", own), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
         ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
         ("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:capture:"), F.col("refers_to").cast("string"), F.lit(":"), "digest", F.lit(":0>")))),
         ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(head, F.when(again, "").otherwise(F.col("html"))))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", name("request")), ("WARC-Concurrent-To", own), *common,
         ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name("metadata")), ("WARC-Concurrent-To", own), *common,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\npayloadBytes: "),
                 F.col("bytes").cast("string"), F.lit("\r\n")))
    records = plan_captures(pages).select(F.explode(F.array(capture, request, metadata)).alias("value"))
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(folder))


def parse_archive(data: bytes) -> Iterator[tuple]:
    """The records of one archive, by their lengths alone, so payloads may hold anything."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        block = data[start:start + int(head["content-length"])]
        at = start + len(block) + 4
        kind, payload, fields = head["warc-type"], None, None
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4:]
        elif kind == "metadata":
            fields = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x]
        yield (kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"),
               hashlib.sha1(payload).hexdigest() if payload is not None else head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
               len(payload) if payload is not None else None, fields, payload)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives in folder. Digests of responses are taken from the payload as read."""
    types = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
    names = [x.split()[0] for x in _RECORD.replace("map<string,string>", "map").split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = gzip.decompress(data.as_py())
                found, size = [], 0
                for record in parse_archive(raw):
                    found.append(record if payloads else (*record[:-1], None))
                    size += len(record[-1] or b"")
                    if size > 8 << 20 or len(found) >= 5000:
                        yield pack(found)
                        found, size = [], 0
                yield pack(found)

    def pack(found: list[tuple]) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*found, strict=True)] if found else [[] for _ in names]
        columns[-1] = [x.decode() if x is not None else None for x in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(folder).where("length > 0").select("content").mapInArrow(rows, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request, metadata.

    Responses and revisits meet their request and metadata records through concurrent-to
    identifiers. A capture without one of the two has null there; records that point to no
    capture are left out. Several requests (or metadata records) of a capture give one row each.
    """
    part = lambda name: F.struct(*[F.col(c) for c in records.columns]).alias(name)
    captures = records.where("record_type in ('response', 'revisit')").select("record_id", part("response"))
    others = {kind: records.where(F.col("record_type") == kind).select(F.col("concurrent_to").alias("record_id"), part(kind))
              for kind in ("request", "metadata")}
    return captures.join(others["request"], "record_id", "left").join(others["metadata"], "record_id", "left")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives below the shared folder, reads them back, and returns one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to, request_uri. Null html is an empty
    payload; empty and short payloads are responses of their own; repeated rows give repeated
    captures; extra columns are ignored; an empty table gives no rows.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder)
    captures = assemble(read_archives(spark, folder, payloads=False))
    fields = F.col("metadata.fields")
    return captures.select(
        F.when(fields["pageId"] != "", fields["pageId"]).cast(kind).alias("page_id"),
        F.coalesce("response.payload_bytes", fields["payloadBytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.split("response.refers_to", ":")[2].cast(kind).alias("refers_to"), F.col("request.target_uri").alias("request_uri"))
