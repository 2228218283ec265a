"""WARC archives: writing, reading, and assembling transactions.

Writing is Spark's own text sink: a record's header, an empty line and its block
are one text value, the record separator of the format (two line ends) is the
sink's line separator, so every part file is a valid gzip-compressed archive, written with Spark's
commit protocol (a lost executor leaves nothing half-written).

Reading unpacks each archive as a stream and cuts it by Content-Length, so a task
holds one packed archive (of `records_per_file` records when written here) and
one record. Request and metadata records name their capture in
WARC-Concurrent-To, or the capture names them; either way they are joined on it.
Revisits find their payload's record through WARC-Refers-To. Payloads are hashed
where they are read and are shuffled only once, when writing finds equal ones.

Edge cases: a null html is an empty payload; a null url is written as an empty
target; payloads of less than `revisit_bytes` are never revisits; repeated
page ids with equal payloads are captures of their own; of rows with the largest
page_id, the last by file and place is the response; several requests or metadata
records of a capture are all kept; other columns are not read; an empty table
gives no rows. A very long page is one record, held whole by its task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, materialize, placed, scratch, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, concurrent_to string, refers_to string, target string, payload_bytes long, payload_digest string, page_id long, payload binary"
CRLF = "\r\n"


def _id(kind: str, key) -> F.Column:
    """key: struct of page_id and the row's place, for page ids may repeat."""
    return F.concat(F.lit(f"<urn:page:{kind}:"), F.coalesce(key["page_id"].cast("string"), F.lit("null")), F.lit(":"), F.hex(key["file"]), F.lit("-"), key["row"].cast("string"), F.lit(">"))


def _record(kind, record_id, target, block, *more) -> F.Column:
    """A record as text; more: (name, column) headers, left out where null."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.concat(F.lit("WARC-Target-URI: "), target), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in more]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 1000, records_per_file: int = 2000) -> None:
    """Three records per page: its response or revisit, its request, its metadata."""
    key = F.col("key")
    target = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    page = placed(pages.select("page_id", "url", "html")).select(F.struct(F.col("page_id").cast("long").alias("page_id"), F.col("q_file").alias("file"), F.col("q_row").alias("row")).alias("key"), target.alias("target"), F.coalesce(F.col("html"), F.lit("")).alias("block"))
    page = page.withColumns({"bytes": F.octet_length("block").cast("long"), "digest": F.sha1(F.col("block").cast("binary")), "sha256": F.sha2(F.col("block").cast("binary"), 256)})
    large = F.col("bytes") >= revisit_bytes
    # written, so that the join below is between plain exchanges and a payload of very many pages can be split over tasks
    firsts = materialize(page.where(large).groupBy("sha256").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha256").alias("of"), "first"), "firsts")
    page = page.join(firsts, large & (F.col("sha256") == F.col("of")), "left")
    revisit = F.col("first").isNotNull() & (F.col("first") != key)
    kind = F.when(revisit, "revisit").otherwise("response")
    of = _id("capture", key)
    shared = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    capture = _record(kind, of, F.col("target"), F.when(revisit, "").otherwise(F.col("block")), *shared, ("WARC-Refers-To", F.when(revisit, _id("capture", F.col("first")))), ("WARC-Profile", F.when(revisit, PROFILE)), ("X-Payload-Length", F.when(revisit, F.col("bytes").cast("string"))))
    request = _record(F.lit("request"), _id("request", key), F.col("target"), F.concat(F.lit("GET "), F.col("target"), F.lit(" HTTP/1.1\r\n\r\n")), ("WARC-Concurrent-To", of))
    metadata = _record(F.lit("metadata"), _id("metadata", key), F.col("target"), F.concat(F.lit("page_id: "), F.coalesce(key["page_id"].cast("string"), F.lit("")), F.lit(CRLF)), ("WARC-Concurrent-To", of))
    records = page.select(F.explode(F.array(request, capture, metadata)).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an unpacked archive."""
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record at its place")
        headers: dict[str, str] = {}
        while line := archive.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = archive.read(size)
        if len(block) != size or archive.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends too soon")
        yield headers, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record; without payloads, their digests and sizes only."""

    def rows_of(packed: bytes) -> Iterator[tuple]:
        for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(packed))):
            kind, page = h["warc-type"], None
            size, digest = len(block), hashlib.sha1(block).hexdigest()
            stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
            if kind == "revisit":
                size, digest = int(h["x-payload-length"]), stated
            elif kind == "response" and stated != digest:
                raise ValueError("a payload differs from its digest")
            if kind == "metadata":
                page = int(x) if (x := block.decode().partition(":")[2].strip()) else None
            yield kind, h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), size, digest, page, block if payloads else None

    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for packed in batch.column("content"):
                rows, held = [], 0
                for row in rows_of(packed.as_py()):
                    rows.append(row)
                    held += 400 + len(row[-1] or b"")
                    if held > batch_bytes:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return in_arrow(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content"), run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response struct, arrays of its request and metadata structs, and, for a revisit, the page of the capture that it refers to."""
    side = F.struct("record_id", "target", "payload_bytes", "payload_digest", "page_id", "payload")
    captures = records.where(F.col("record_type").isin("response", "revisit"))
    capture = captures.select(F.col("record_id").alias("capture_id"), "record_type", "refers_to", side.alias("response"))
    # a capture may name its request or metadata instead of being named by them
    named = captures.where("concurrent_to is not null").select(F.col("concurrent_to").alias("named"), F.col("record_id").alias("by"))
    others = records.where(F.col("record_type").isin("request", "metadata")).join(named, F.col("record_id") == F.col("named"), "left")
    # requests and metadata of one capture meet in one aggregate on the identifier that they are concurrent to
    list_of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("record_type") == kind, side)))
    others = others.groupBy(F.coalesce("by", "concurrent_to").alias("of")).agg(list_of("request").alias("requests"), list_of("metadata").alias("metadata"))
    whole = capture.join(others, F.col("capture_id") == F.col("of"), "left").drop("of")
    # a popular page's revisits are many; each needs only the page that its response's metadata names
    pages = whole.where("record_type = 'response'").select(F.col("capture_id").alias("of"), F.col("metadata")[0]["page_id"].alias("refers_to_page"))
    revisits = whole.where("record_type = 'revisit'").join(pages, F.col("refers_to") == F.col("of"), "left").drop("of")
    return whole.where("record_type = 'response'").withColumn("refers_to_page", F.lit(None).cast("long")).unionByName(revisits)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    whole = assemble(materialize(read_archives(spark, path, payloads=False), "records"))
    return whole.select(F.col("metadata")[0]["page_id"].alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"))


OP1_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, h, cast(octet_length(encode(h)) as bigint) n from p),
f as (select h, max(page_id) f from d where n >= 1000 group by h)
select page_id, n payload_bytes, sha1(d.h) payload_digest,
  case when f is null or f = page_id then 'response' else 'revisit' end record_type,
  case when f is null or f = page_id then null else f end refers_to
from d left join f on d.h = f.h and d.n >= 1000
"""
