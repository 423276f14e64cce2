"""WARC archives and transaction assembly (operator 3).

``write_warc`` writes a response or revisit, a request and a metadata record for
each page; ``read_records`` reads archives; ``assemble`` joins the records of a
transaction through WARC-Concurrent-To and emits one nested row per capture.

Spark's text writer streams the records to any file system: it ends each row
with the two line ends that end a WARC record. The files are gzip streams.
Reading follows Content-Length alone, so payloads may hold anything."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_path, stage

CRLF = "\r\n"
#: Bytes of records in a file, on average; payloads that revisits may stand for.
FILE_BYTES, LEAST_BYTES = 64 << 20, 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
          "declared_digest string, payload_bytes bigint, payload_sha256 string, fields map<string,string>, payload binary")


def _urn(kind: str, page_id: Column, url: Column, digest: Column) -> Column:
    """A record id made of what the record is about, the same whenever it is made."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without the two line ends after it; null headers are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)) for k, v in headers]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "),
                    F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2000-01-01T00:00:00Z",
               file_bytes: int = FILE_BYTES) -> None:
    """Write page_id, url, html of ``pages``, a transaction per row.

    Of equal payloads of at least ``least_bytes`` bytes that with the smallest
    page_id (null is the largest) is the response and the others are revisits of it; rows
    that tie for it are all responses. Null html: empty payload. Null url or
    page_id: no such header or field. Line ends in a url are written as %0D, %0A.
    Other columns are not read; no rows: no records. Repeated payloads are found by
    partially aggregated digests; the payloads are not shuffled unless those
    digests are too many to broadcast."""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", uri.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html").cast("long"))
    by = rows.filter(F.col("n") >= least_bytes).groupBy(F.col("digest").alias("d_")).agg(
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"))
    by = stage(by.filter("copies > 1").select("d_", "first.page_id", "first.url").toDF("d_", "first_id", "first_url"), "payloads")
    size = rows.agg(F.avg(F.col("n") + 1500)).first()[0] or 1.0
    rows = rows.join(broadcast_if_small(by), F.col("digest") == F.col("d_"), "left")
    again = F.col("d_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(again, "revisit").otherwise("response")
    own = _urn("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    of = F.when(again, _urn("capture", F.col("first_id"), F.col("first_url"), F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(CRLF + CRLF), F.when(again, "").otherwise(F.col("html")))
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    # only the columns that each record needs: the id of the capture is made once
    rows = rows.select("page_id", "url", "digest", kind.alias("kind"), own.alias("own"), of.alias("of"), http.alias("http"))
    rev = F.col("of").isNotNull()
    capture = _record([("WARC-Type", F.col("kind")), ("WARC-Record-ID", F.col("own")), *common, digest,
                       ("WARC-Profile", F.when(rev, PROFILE)), ("WARC-Refers-To", F.col("of")),
                       ("Content-Type", "application/http; msgtype=response")], F.col("http"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://([^/?#]*)", 1)
    target = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1" + CRLF + "Host: "), host,
                   F.lit(CRLF + CRLF))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("page_id"), F.col("url"), F.col("digest"))),
                       *common, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/http; msgtype=request")], ask)
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
                     F.lit("charset: utf-8" + CRLF))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("page_id"), F.col("url"), F.col("digest"))),
                        *common, ("WARC-Concurrent-To", F.col("own")), ("Content-Type", "application/warc-fields")], about)
    out = rows.select(F.explode(F.array(capture, request, metadata)).alias("value"))
    out.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option(
        "maxRecordsPerFile", max(300, int(3 * file_bytes / size))).text(path)


def _fields(data: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in data.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, colon, v in lines if colon}


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive, plain or gzip. Names are in lower case."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        headers = _fields(b"".join(head))
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield headers, block


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record below ``path``; columns as in ``RECORD``. fields: those
    of a metadata block, else the HTTP headers. payload: the HTTP body; left null
    where ``payloads`` is false, when its length and digest alone are wanted."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                raw = data.as_py()
                stream = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
                rows, size = [], 0
                for h, block in parse_warc(io.BufferedReader(stream) if hasattr(stream, "peek") else stream):
                    kind = h.get("content-type", "")
                    body, fields = (None, _fields(block)) if kind == "application/warc-fields" else (block, {})
                    if kind.startswith("application/http"):
                        top, _, body = block.partition(b"\r\n\r\n")
                        fields = _fields(top.partition(b"\r\n")[2])
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                                 h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"),
                                 None if body is None else len(body), None if body is None else hashlib.sha256(body).hexdigest(),
                                 list(fields.items()), body if payloads else None))
                    size += 500 + len(block) * payloads
                    if size > 4 << 20:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    return files.select("content").mapInArrow(run, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = [text] * 7 + [pa.int64(), text, pa.map_(text, text), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, date, and the structs
    response (of a response or revisit record), request and metadata.

    Requests and metadata belong to the capture that they are concurrent to; of
    several, the one with the smallest record id is kept. A request or metadata
    record without a capture gives a row with a null response. Captures
    with one record id, as repeated rows have, stay as many rows."""
    is_capture = F.col("warc_type").isin("response", "revisit")
    shared = ["warc_type", "record_id", "declared_digest", "fields"]
    capture = records.filter(is_capture).select(
        F.col("record_id").alias("capture_id"), "target_uri", "date",
        F.struct(*shared, "refers_to", "payload_bytes", "payload_sha256", "payload").alias("response"))

    def other(kind):
        key = F.coalesce("concurrent_to", "record_id").alias("capture_id")
        rows = records.filter(F.col("warc_type") == kind).select(key, F.struct("record_id", "target_uri", "date", "fields").alias(kind))
        return rows.groupBy("capture_id").agg(F.min_by(kind, f"{kind}.record_id").alias(kind))

    out = capture.join(other("request"), "capture_id", "full_outer").join(other("metadata"), "capture_id", "full_outer")
    first = lambda c: F.coalesce(c, f"request.{c}", f"metadata.{c}").alias(c)
    return out.select("capture_id", first("target_uri"), first("date"), "response", "request", "metadata")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Payload length and digest of each capture, revisits resolved through the
    response they refer to: page_id, payload_bytes, payload_digest, record_type,
    refers_to. A payload that contradicts its declared digest is an error."""
    rows = assemble(read_records(spark, path, payloads=False)).filter("response is not null").select(
        "capture_id", F.col("metadata.fields")["page-id"].cast("bigint").alias("page_id"),
        F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("of"),
        F.regexp_replace("response.declared_digest", "^sha256:", "").alias("declared"),
        F.col("response.payload_bytes").alias("n"), F.col("response.payload_sha256").alias("sha256"))
    rows = stage(rows, "captures")
    of = rows.filter("of is not null").select("of").distinct()
    seen = rows.filter("record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("page_id").alias("refers_to"),
                                                          F.col("n").alias("of_n"), F.col("sha256").alias("of_sha256"))
    seen = seen.join(of, "of", "left_semi").dropDuplicates(["of"])
    rows = rows.join(broadcast_if_small(seen), "of", "left")
    digest = F.coalesce("of_sha256", "sha256")
    checked = F.when(F.col("declared") == digest, digest).otherwise(F.raise_error(F.lit("payload and declared digest differ")))
    return rows.select("page_id", F.coalesce("of_n", "n").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def write_and_read(pages: DataFrame) -> DataFrame:
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return captures(pages.sparkSession, path)
