"""WARC archives: writing with revisit records, reading with segment reassembly.

Writing. A payload becomes an HTTP response in chunked transfer framing. Blocks
longer than a segment are split: the first record has segment number 1, the
following are ``continuation`` records that name the first as their origin, the
last gives the total length. Of equal payloads the record with the largest
identifier is the response; the others are ``revisit`` records that refer to it
and hold no payload. Archives are written by Spark's text writer with a record
per line and WARC's closing blank lines as the line separator, so any file
system that Spark writes to will do.

Reading. A file is parsed record by record by its stated lengths. Unsegmented records are
decoded on the spot; only segments are grouped by origin, ordered by number,
checked against the total length and decoded. Digest and length of every
decoded payload are checked against the record's header.

Bounds: a task holds one file, at most ``RECORDS_PER_FILE`` segments, and a
group one record's segments.

Cases: null html is an empty payload; null urls leave the target out; rows
that repeat an identifier are records of their own, and if they share the
largest identifier of their payload all are responses; a null identifier
refers to the largest of its payload's identifiers, or is a response if there is none.
Empty texts are payloads of no bytes and equal to each other; very long texts are many segments.
An empty table writes an archive without records. Columns beyond the three
named are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import Workspace

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_PER_FILE = 2_000
END = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

PARSED = (
    "doc_id long, record_id string, origin string, segment int, total long, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, block binary"
)


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = bytearray()
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += b"%x\r\n%s\r\n" % (len(part), part)
    return bytes(out + b"0\r\n\r\n")


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are allowed, anything else is an error."""
    out, at = bytearray(), 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";", 1)[0], 16)
        at = end + 2
        if size == 0:
            return bytes(out)
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out += framed[at : at + size]
        at += size + 2


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank lines that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def record_name(row: int) -> str:
    return f"<urn:skaldic:record:{row}>"


def records_of(row: int, doc_id, url, payload: bytes, keep_id, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one row: a revisit, or a response in as many segments as it takes."""
    own = [("WARC-Record-ID", record_name(row)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if doc_id is not None:
        own.append(("X-Document-ID", str(doc_id)))
    if url is not None:
        own.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    digest = [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if keep_id is not None and doc_id != keep_id:
        revisit = [
            ("WARC-Type", "revisit"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Document-ID", str(keep_id)),
        ]
        yield record([*revisit, *own, *digest], HTTP_HEAD + b"Content-Length: %d" % len(payload) + END)
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked" + END + chunked(payload)
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(parts) == 1:
        yield record([("WARC-Type", "response"), *own, kind, *digest], block)
        return
    for k, part in enumerate(parts, 1):
        number = ("WARC-Segment-Number", str(k))
        if k == 1:
            yield record([("WARC-Type", "response"), *own, kind, *digest, number], part)
            continue
        fields = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:skaldic:record:{row}:{k}>"),
            own[1],
            ("WARC-Segment-Origin-ID", record_name(row)),
            number,
        ]
        if k == len(parts):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(fields, part)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start = end + len(END)
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != END:
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(END)
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def revisit_length(block: bytes) -> int | None:
    for line in block.split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            return int(line.split(b":", 1)[1])
    return None


def checked(payload: bytes, stated: str | None) -> tuple[int, str]:
    digest = sha1_base32(payload)
    if stated and stated != digest:
        raise ValueError(f"payload has digest {digest}, its record states {stated}")
    return len(payload), digest


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
) -> None:
    """Write archives of all rows below ``path``."""
    ws = Workspace(pages.sparkSession, "warc-keys")
    rows = pages.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"),
    ).withColumns({"digest": F.unhex(F.sha1("body")), "n_bytes": F.octet_length("body"), "check": F.xxhash64("body")})
    # SHA-1 alone can be made to collide; payloads are equal if length and a second hash agree too.
    same = ["digest", "n_bytes", "check"]
    shared = ws.keep(
        rows.groupBy(*same).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "shared",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols = [c.to_pylist() for c in batch.slice(at, 256).columns]
                out = [
                    x
                    for row, doc, url, body, keep in zip(*cols, strict=True)
                    for x in records_of(row, doc, url, body, keep, segment_bytes)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (
        # Digests that no other row has meet an absent group; the groups are joined by their size at run time.
        rows.join(shared, same, "left")
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "url", F.col("body").cast("binary").alias("body"), "keep_id")
        .mapInArrow(write, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", END.decode())
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: doc_id, payload_bytes, payload_digest, record_type, refers_to, payload not kept."""
    ws = Workspace(spark, "warc-read")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARSED.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in PARSED.split(", ")]

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for f, block in parse(batch.column(0)[k].as_py()):
                    kind, number = f["warc-type"], _number(f.get("warc-segment-number"))
                    stated = f.get("warc-payload-digest", "").rpartition(":")[2] or None
                    length = digest = None
                    if kind == "revisit":
                        length, digest, block = revisit_length(block), stated, None
                    elif number is None:
                        length, digest = checked(http_payload(block), stated)
                        block = None
                    else:
                        digest = stated
                    name = f["warc-record-id"]
                    rows.append(
                        (
                            _number(f.get("x-document-id")), name, f.get("warc-segment-origin-id", name), number,
                            _number(f.get("warc-segment-total-length")), kind,
                            _number(f.get("x-refers-to-document-id")), length, digest, block,
                        )
                    )
                    if len(rows) == 500:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, stated, total, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise ValueError(f"segments of record {doc} are missing or do not add up to {total} bytes")
                out.append((doc, *checked(http_payload(block), stated)))
            if out:
                cols = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "payload_bytes", "payload_digest"]
                )

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    parsed = ws.keep(files.mapInArrow(read, PARSED), "parsed")
    whole = parsed.filter("segment is null")
    segments = parsed.filter("segment is not null").groupBy("origin").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("payload_digest").alias("stated"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    joined = segments.select("doc_id", "stated", "total", "parts").mapInArrow(
        decode, "doc_id long, payload_bytes long, payload_digest string"
    )
    out = ["doc_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(*out).unionByName(
        joined.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(*out)
    )
