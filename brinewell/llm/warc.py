"""WARC archives: distributed writing, reading back, and assembly of captures.

A page is written as three records, request, response (or revisit) and
metadata, tied by WARC-Concurrent-To. Spark's own text writer commits the
files, so they land in any store that Spark can write, and lost tasks leave
nothing behind; for that a file is one gzip member, has Spark's name and no
warcinfo record. Reading parses whole files by Content-Length, one pass over
them, and takes archives of one member a record just as well.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.plans.lineage import cut, small
from brinewell.plans.skew import join_heavy

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 1000
#: Bytes of payload in one archive file, about, and at most (a greater payload has a file of its own).
FILE_BYTES, MOST_BYTES = 16 << 20, 256 << 20
#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = "record_id string, kind string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, digest string, block_bytes long, payload_bytes long, payload_sha1 string, payload binary, info string"
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in _RECORD.split(", ")])


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.to_json(F.struct(*(x.alias(f"p{k}") for k, x in enumerate(parts))), {"ignoreNullFields": "false"}).cast("binary"))
    return F.concat(F.lit(f"<urn:capture:{kind}:"), h, F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that close it; a header with a null value is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write three records for each row of ``pages`` to gzipped files in ``path``.

    Of rows with equal payloads of MIN_REVISIT bytes or more, those with the
    largest id hold the payload and the others revisit it, and name it in
    WARC-Refers-To. Null html is an empty payload; null ids and urls are kept as
    such in the metadata record. Repeated rows are each written, under one
    record id. An empty table writes no record. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    shared = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = cut(shared, "shared_payloads")
    total = rows.agg(F.sum(F.col("bytes") + 1500).alias("b"), F.count("*").alias("n"), F.max("bytes").alias("most")).first()
    rows = rows.join(small(shared), "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))
    rows = rows.withColumn("revisit", revisit).withColumn("rid", _record_id("response", F.col("page_id"), F.col("url"), F.col("digest")))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")
    stamp = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", clean)]
    tied = ("WARC-Concurrent-To", F.col("rid"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    own = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("rid")), *stamp, digest, ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("html")))
    refers = _record_id("response", F.col("top.page_id"), F.col("top.url"), F.col("digest"))
    again = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", F.col("rid")), *stamp, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    ask = F.concat(F.lit("GET "), F.coalesce(clean, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.replace(F.col("rid"), F.lit(":response:"), F.lit(":request:"))), *stamp, tied, ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    facts = F.to_json(F.struct("page_id", "url"))
    meta = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", F.replace(F.col("rid"), F.lit(":response:"), F.lit(":metadata:"))), *stamp, tied, ("Content-Type", F.lit("application/json"))], facts)
    pages_a_file = min(FILE_BYTES * max(total["n"], 1) // max(total["b"] or 0, 1), MOST_BYTES // max(total["most"] or 0, 1))
    per_file = 3 * max(1, pages_a_file)
    out = rows.select(F.explode(F.array(request, F.when(F.col("revisit"), again).otherwise(own), meta)).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _parse(with_payload: bool):
    def records(data: bytes) -> Iterator[tuple]:
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head.get("content-length", 0))
            block = data[end + 4 : end + 4 + size]
            at = end + 4 + size + 4
            kind, payload = head.get("warc-type"), block
            if head.get("content-type", "").startswith("application/http"):
                payload = block.partition(b"\r\n\r\n")[2]
            elif kind == "metadata":
                payload = b""
            info = block.decode("utf-8", "replace") if kind == "metadata" else None
            yield head.get("warc-record-id"), kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), head.get("content-type"), head.get("warc-payload-digest"), size, len(payload), hashlib.sha1(payload).hexdigest(), payload if with_payload else None, info

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for r in records(data):
                    rows.append(r)
                    size += r[8]
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``; digest and length are always of the whole payload."""
    spark_files = spark.read.format("binaryFile").load(path).select("content")
    return spark_files.mapInArrow(_parse(with_payload), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row ``(capture_id, response, request, metadata)`` per response or revisit record.

    Requests and metadata meet their response through WARC-Concurrent-To, in one
    pass over the records; where one is missing its struct is null, and of
    several with one id any is taken. Responses that share a record id are
    repeats of one capture and keep a row each. Records of other kinds, and
    those tied to no response, make no row.
    """
    main = F.col("kind").isin("response", "revisit")
    whole = F.struct("record_id", "kind", "refers_to", "target_uri", "date", "content_type", "digest", "payload_bytes", "payload_sha1", "payload")
    side = F.struct("record_id", "target_uri", "date", "content_type", "payload_bytes", "info")
    kinds = records.where(main | (F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull()))
    kinds = kinds.groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")).agg(
        F.first(F.when(main, whole), True).alias("response"),
        *(F.first(F.when(F.col("kind") == k, side), True).alias(k) for k in ("request", "metadata")),
        F.count_if(main).alias("n"),
    )
    each = kinds.where("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("capture_id", "response", "request", "metadata")


def page_facts(captures: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of captures written by :func:`write_warc`.

    What a revisit refers to, and the length of its payload, are those of the
    capture that its WARC-Refers-To names.
    """
    page = F.from_json("metadata.info", "page_id long")["page_id"]
    digest = F.when(F.col("response.kind") == "revisit", F.substring("response.digest", 6, 40)).otherwise(F.col("response.payload_sha1"))
    facts = cut(captures.select("capture_id", page.alias("page_id"), F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("named"), F.col("response.payload_bytes").alias("payload_bytes"), digest.alias("payload_digest")), "captures")
    own, again = facts.where("record_type = 'response'"), facts.where("record_type = 'revisit'")
    wanted = again.groupBy("named").agg(F.count("*").alias("n"))
    held = own.groupBy(F.col("capture_id").alias("named")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("own_bytes"))
    referred = join_heavy(again.drop("payload_bytes"), cut(wanted.join(held, "named"), "referred"), ["named"], "n")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(referred.withColumnRenamed("own_bytes", "payload_bytes").select(*columns))
