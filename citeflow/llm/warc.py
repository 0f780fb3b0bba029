"""WARC archives with revisit resolution.

Headers (id, digest, size) are shuffled by payload digest; each digest's original is found with map-side
aggregation, the others join to it and become revisit records without payload. Archives are written with
fresh headers, one gzip member per record, by Spark's own text writer, and read back by Spark's
binary-file reader, so that any store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.llm.shared import ROW, materialise, new_path, numbered

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: From this many bytes on, the last byte of a gzip member (the highest of its size) is not zero.
LARGE = 1 << 24
#: Bytes of records that a file holds at most, so that one file is one row of a reader.
FILE_BYTES = 1 << 27
#: Compressed bytes that a reader expands at once.
STEP = 1 << 16


def resolve_revisits(headers: DataFrame, *, least_bytes: int = 1000) -> DataFrame:
    """(row, refers_to, refers_row, refers_uri) of the records that revisit another.

    ``headers`` has a row number, record_id, uri, payload_digest, payload_bytes. Of records with equal
    digest and size of at least ``least_bytes`` the largest record_id is the original, the latest row of
    those with that id; records with the original's id are originals themselves. Null ids never revisit.
    """
    able = headers.where((F.col("payload_bytes") >= least_bytes) & F.col("record_id").isNotNull())
    groups = able.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("record_id", ROW, "uri")).alias("first"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1").select("payload_digest", "payload_bytes", "first")
    met = able.join(groups, ["payload_digest", "payload_bytes"]).where(F.col("record_id") != F.col("first.record_id"))
    return met.select(ROW, F.col("first.record_id").alias("refers_to"), F.col(f"first.{ROW}").alias("refers_row"), F.col("first.uri").alias("refers_uri"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def record_text(date: str) -> Column:
    """A WARC/1.1 record, from the row number, record_id, uri, payload, payload_digest, payload_bytes,
    refers_to, refers_row and refers_uri. Row numbers make the identifiers of records unique."""
    uri = F.coalesce(F.regexp_replace("uri", r"[\x00-\x20\x7f]+", "%20"), F.lit("urn:unknown"))
    urn = lambda c, row: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    more = F.when(
        revisit,
        F.concat(
            _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            _line("WARC-Refers-To", urn("refers_to", "refers_row")),
            _line("WARC-Refers-To-Target-URI", F.coalesce(F.regexp_replace("refers_uri", r"[\x00-\x20\x7f]+", "%20"), F.lit("urn:unknown"))),
        ),
    ).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise("response")),
        _line("WARC-Record-ID", urn("record_id", ROW)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        more,
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head, http, body, F.lit("\r\n\r\n"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as one gzip member, without its last byte."""
    for batch in batches:
        out, held = [], 0
        for raw in batch.column(0).cast(pa.binary()):
            z = zlib.compressobj(3, zlib.DEFLATED, 31)
            out.append((z.compress(raw.as_buffer()) + z.flush())[:-1])
            held += len(out[-1])
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", most_records: int = 5000) -> None:
    """Write a record for each row of ``pages`` (record_id, uri, payload) under ``path``, one gzip member each.

    The payload is UTF-8; null is empty. Null uris become ``urn:unknown``. Rows that repeat an id, or
    have none, are records of their own; other columns are ignored. An empty table writes no record.
    Records may have any size that a string has; a file holds FILE_BYTES of records (or one record), as the
    largest of its class allows. Only headers are shuffled by digest.

    A member ends with its size, lowest byte first. Spark's text writer puts the last byte as its line
    separator: a zero below 16 MiB, and the few larger records are written once for each last byte.
    """
    given = pages.select("record_id", "uri", F.coalesce("payload", F.lit("")).alias("payload"))
    given = numbered(given.withColumns({"payload_digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")}))
    revisits = materialise(resolve_revisits(given.drop("payload"), least_bytes=least_bytes), "revisits")
    lines = given.join(revisits, ROW, "left").select(F.coalesce(F.octet_length("uri"), F.lit(0)).alias("uri_bytes"), "payload_bytes", record_text(date).alias("record"))
    # What a record has beside its payload: fixed lines, two ids and twice a uri (at most three bytes for one).
    reach = F.col("payload_bytes") + 6 * F.col("uri_bytes") + 4096
    small = (given.where(F.col("payload_bytes") < LARGE).agg(F.max("payload_bytes")).first()[0] or 0) + 8192
    able = lines.where(reach >= LARGE).select(F.expr(f"octet_length(record) div {LARGE}").alias("top")).distinct()
    tops = sorted({0} | {r.top for r in able.collect()})  # at most 128 values
    for top in tops:
        chosen = lines if tops == [0] else lines.where(F.expr(f"octet_length(record) div {LARGE} = {top}"))
        records = max(1, min(most_records, FILE_BYTES // (small if not top else (top + 1) * LARGE)))
        members = chosen.select("record").mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
        members.write.mode("append").option("lineSep", chr(top)).option("maxRecordsPerFile", records).text(path)


def _expand(content: memoryview) -> Iterator[bytes]:
    """The members of a gzip file, in time linear in its size."""
    at = 0
    while at < len(content):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            step = content[at : at + STEP]
            if not step:
                raise ValueError("an archive is cut off")
            parts.append(z.decompress(step))
            at += len(step)
        at -= len(z.unused_data)
        yield b"".join(parts)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of every record of an archive; each is a member of its own."""
    for data in _expand(memoryview(content)):
        end = data.find(b"\r\n\r\n")
        if not data.startswith(b"WARC/1.1\r\n") or end < 0:
            raise ValueError("not a WARC record")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in data[:end].decode().split("\r\n")[1:])}
        size = int(head["content-length"])
        if len(data) != end + 8 + size or data[-4:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield head, memoryview(data)[end + 4 : end + 4 + size]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record under ``path``: record_id, uri, record_type, refers_to, payload_digest,
    payload_bytes, payload (null for revisits). A response's digest and size are those of the bytes read; for a
    revisit they are the ones its headers state. A folder without archives gives an empty table; a broken
    record, length or digest raises."""
    names = ["record_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").partition(":")[0]
        return int(digits) if digits else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in _records(content.as_buffer()):
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    begin = bytes(block[:4096]).find(b"\r\n\r\n") + 4
                    if head["warc-type"] == "response":
                        payload = block[begin:]
                        found, size, text = hashlib.sha1(payload).hexdigest(), len(payload), str(payload, "utf-8")
                        if found != digest:
                            raise ValueError(f"digest of {head['warc-record-id']} is wrong")
                    else:
                        size = next(int(x.split(b":")[1]) for x in bytes(block[:begin]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        text = None
                    rows.append((number(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], number(head.get("warc-refers-to")), digest, size, text))
                    held += len(text or "")
                    if len(rows) == 2000 or held > 1 << 23:
                        yield make(rows)
                        rows, held = [], 0
                if rows:
                    yield make(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, "record_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).alias("uri"), F.col(payload_col).alias("payload")), path, least_bytes=least_bytes)
    return read_archives(pages.sparkSession, path).withColumnRenamed("record_id", id_col)
