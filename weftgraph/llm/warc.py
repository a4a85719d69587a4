"""WARC archives as a chunked record table.

A record is a run of rows (record_id, chunk_no): chunk 0 begins with the record's WARC/1.1 header, the last
chunk ends with the record's closing line ends, and the rows' bytes in order are the record. Payloads are
cut into chunks by the JVM before anything else touches them, so no later row, shuffle or Python worker
holds more than one chunk of an oversized record. Writer and reader carry an incremental SHA-1 from chunk
to chunk; the reader checks it against the header's payload digest.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a response;
the others are revisits, which name it and hold no payload. In the join that finds them a payload that many pages
share is salted by record: the more pages share it, the more salts it has, about one for ``SALT_ROWS`` pages.

Defined cases: a null html is an empty payload; empty payloads are responses of length 0; rows that repeat a
page_id are records of their own (equal rows with the largest id are all responses); rows with a null id are
never named by revisits, and are responses where all ids of their payload are null; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

CHUNK, LEAST, SALT_ROWS, MOST_HOT = 1 << 20, 1000, 20_000, 100_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ROW = "record_id string, chunk_no int, n_chunks int, data binary, running_digest string"


def header(record_id: str, page_id: str, url: str, kind: str, size: int, digest: str, refers_to: str | None) -> bytes:
    """The WARC header and the HTTP header that begins its block; ``size`` is the full payload's."""
    http = _HTTP % size
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:weft:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page_id}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, sha = None, hashlib.sha1()
    for b in batches:
        out: list[tuple] = []
        for record, no, n, page, url, kind, size, digest, refers, chunk in zip(*(b.column(i) for i in range(10)), strict=True):
            record, no, n = record.as_py(), no.as_py(), n.as_py()
            if record != own:
                own, sha = record, hashlib.sha1()
            sha.update(data := chunk.as_py())
            if no == 0:
                data = header(record, page.as_py() or "", url.as_py(), kind.as_py(), size.as_py(), digest.as_py(), refers.as_py()) + data
            out.append((record, no, n, data + b"\r\n\r\n" if no == n - 1 else data, sha.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["record_id", "chunk_no", "n_chunks", "data", "running_digest"])


class _Record:
    """A record that is read chunk by chunk: header fields, payload bytes counted and digested so far."""

    def __init__(self, data: bytes):
        head, rest = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("no WARC header")
        self.fields = dict(x.split(": ", 1) for x in lines[1:])
        self.sha, self.size, self.kind = hashlib.sha1(), 0, self.fields["WARC-Type"]
        self.left = int(self.fields["Content-Length"])
        http = rest.index(b"\r\n\r\n") + 4
        self.left -= http
        self.feed(rest[http:])

    def feed(self, data: bytes) -> None:
        data = data[: self.left]
        self.left -= len(data)
        self.size += len(data)
        self.sha.update(data)

    def row(self) -> tuple:
        digest = self.fields["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(self.fields["X-Payload-Length"])
        if self.left or (self.kind == "response" and (self.sha.hexdigest() != digest or self.size != size)):
            raise ValueError(f"record {self.fields['WARC-Record-ID']} is damaged")
        if self.kind == "response":
            digest, size = self.sha.hexdigest(), self.size
        refers = self.fields.get("X-Refers-To-Page")
        return self.fields["X-Page-ID"] or None, size, digest, self.kind, refers


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    record: _Record | None = None
    for b in batches:
        out = []
        for no, n, data in zip(b.column(1), b.column(2), b.column(3), strict=True):
            no, n = no.as_py(), n.as_py()
            if no == 0:
                record = _Record(data.as_py())
            else:
                record.feed(data.as_py())
            if no == n - 1:
                out.append(record.row())
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def salted(shared: DataFrame, salt_rows: int = SALT_ROWS, most: int = MOST_HOT) -> DataFrame:
    """digest, size, salts of the payloads (digest, size, c) that more pages share than one task should meet. Only a
    ``most``-th part of all sharing pages counts as that many, so there are ``most`` rows at most, and they are broadcast."""
    total = shared.agg(F.sum("c")).first()[0] or 0
    least = max(100, total // most)
    salts = F.ceil(F.col("c") / max(100, min(salt_rows, total // 1000))).cast("int")
    return F.broadcast(shared.filter(F.col("c") > least).select("digest", "size", salts.alias("salts")))


def record_table(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """The archive of ``pages`` (page_id, url, html) as rows of record_id, chunk_no, n_chunks, data, running_digest."""
    ship(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    whole = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    whole = whole.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    large = whole.filter(F.col("size") >= least)
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND best IS NOT NULL")
    first = materialize(first, "warc-shared")
    hot = salted(first)
    first = first.join(hot, ["digest", "size"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    first = first.select("digest", "size", "best", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    numbered = whole.withColumn("record_id", F.concat_ws("-", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.hex(F.monotonically_increasing_id())))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk)).cast("int")
    cut = numbered.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    cut = cut.withColumn("chunk", F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})")).drop("payload")
    cut = cut.join(hot, ["digest", "size"], "left").withColumn("salt", F.pmod(F.xxhash64("record_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    joined = cut.join(first, ["digest", "size", "salt"], "left")
    again = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    joined = joined.withColumn("kind", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
    joined = joined.filter("kind = 'response' OR chunk_no = 0").withColumn("n_chunks", F.when(again, F.lit(1)).otherwise(F.col("n_chunks")))
    joined = joined.withColumn("chunk", F.when(again, F.lit(b"")).otherwise(F.col("chunk"))).withColumn("refers", F.when(again, F.col("best").cast("string")))
    # a record's chunks share digest and salt, hence a partition; they are put in order there
    ordered = joined.sortWithinPartitions("record_id", "chunk_no").select("record_id", "chunk_no", "n_chunks", F.col("page_id").cast("string"), "url", "kind", "size", "digest", "refers", "chunk")
    return ordered.mapInArrow(_write, ROW)


def read_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (ids as strings) of every record.

    Records of one chunk are read where they lie; only the chunks of longer ones are gathered by record.
    """
    ship(records.sparkSession)
    shape = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    short = records.filter("n_chunks = 1").mapInArrow(_read, shape)
    long = records.filter("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, shape)
    return short.union(long)


def round_trip(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write the archive to the shared folder and read it back: one row per page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    back = read_records(materialize(record_table(pages, chunk, least), "warc", "zstd"))
    return back.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best IS NOT NULL AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM b
"""
