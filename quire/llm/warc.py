"""Legacy archives to WARC: converter, writer and reader (operator 10).

An ARC file starts with a version block whose body names the header layout:
version 1 lines are ``URL IP-address Archive-date Content-type Archive-length``,
version 2 lines add ``Result-code Checksum Location Offset Filename`` before
the length.  Bodies are cut by the declared length, never by searching for the
next header.  Every record becomes one WARC 1.1 record: the identifier is a
name-based UUID of (archive name, offset), the date is the ARC date in ISO
form, the type follows the body (``warcinfo`` for the version block,
``response`` for HTTP, ``resource`` for anything else), and SHA-1 digests of
payload and block are computed.  Equal payloads may be written once and
referred to by ``revisit`` records.

Archive files are made as one row each, of about ``file_bytes`` (one larger
record is a file of its own), and pass through Spark's own writers and readers,
so any store works and a retried task replaces its files.  A task holds one
archive at a time.  Spark's text writer ends every file with one line feed
(and gzips the whole file if asked); the readers skip it.

Defined cases: an empty body has an empty payload; no input rows give no
files, and reading them gives no rows; identical rows are separate records.
Bodies that are not valid UTF-8 are carried as they are.  A header line that
does not parse raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("rec_id string, warc_type string, target_uri string, warc_date string, content_type string, "
          "http_header binary, payload binary, payload_bytes long, payload_digest string, block_digest string")
READ = ("rec_id string, warc_type string, target_uri string, warc_date string, refers_to_id string, "
        "http_header binary, payload_bytes long, payload_digest string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def warc_date(arc_date: str) -> str:
    """``YYYYMMDD[HHMM[SS]]`` as WARC-Date; what is missing counts as its least value."""
    d = arc_date + "00010101000000"[len(arc_date):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def inflate(data: bytes) -> bytes:
    """Gunzip all members of ``data``; other bytes are returned as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(archive name, offset, header fields, body) of each record, the version block first."""
    fields, name, at = ARC_FIELDS[1].split(), "", 0
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        first = line.startswith("filedesc://")
        layout = ARC_FIELDS[1].split() if first else fields  # the version block has a version 1 line
        values = line.rsplit(" ", len(layout) - 1)
        if len(values) != len(layout) or not values[-1].isdigit():
            raise ValueError(f"ARC header at {at}: {line[:200]!r}")
        head = dict(zip(layout, values))
        size = int(head["Archive-length"])
        body = data[end + 1:end + 1 + size]
        if len(body) != size:
            raise ValueError(f"ARC record at {at}: {size} bytes declared, {len(body)} left")
        if first:
            name = head["URL"][len("filedesc://"):]
            fields = ARC_FIELDS[int(body.split(b" ", 1)[0])].split()
        yield name, at, head, body
        at = end + 1 + size


def _convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for name, at, head, body in parse_arc(inflate(content.as_py())):
                http, payload, kind, ctype = b"", body, "resource", head["Content-type"]
                if head["URL"].startswith("filedesc://"):
                    kind, ctype = "warcinfo", "application/warc-fields"
                elif body.startswith(b"HTTP/"):
                    kind, ctype = "response", "application/http; msgtype=response"
                    http, sep, payload = body.partition(b"\r\n\r\n")
                    http += sep
                rows.append((str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{at}")), kind, head["URL"],
                             warc_date(head["Archive-date"]), ctype, http, payload, len(payload),
                             sha1_base32(payload), sha1_base32(body)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[
                    "rec_id", "warc_type", "target_uri", "warc_date", "content_type", "http_header", "payload",
                    "payload_bytes", "payload_digest", "block_digest"])


def convert_arcs(spark: SparkSession, path: str) -> DataFrame:
    """Records (schema ``RECORD``) of all ARC files in the folder ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_convert, RECORD)


def first_of_payload(keys: DataFrame, order: str, min_bytes: int = 0) -> DataFrame:
    """Which record each one repeats, from ``keys(rec_id, order, payload_bytes, payload_digest)``.

    Of equal payloads of at least ``min_bytes`` the record least in
    (``order``, rec_id) stands.  Returns ``rec_id, refers_to_id`` (null for
    those that stand).  The minimum is a partial aggregate; the join on a very
    common digest carries a few short columns and can be split.
    """
    first = (keys.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
             .agg(F.min(F.struct(order, "rec_id")).alias("first"))
             .select("payload_digest", "payload_bytes", F.col("first.rec_id").alias("first_id")))
    return (keys.join(first, ["payload_digest", "payload_bytes"], "left")
            .select("rec_id", F.when(F.col("first_id") != F.col("rec_id"), F.col("first_id")).alias("refers_to_id")))


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


def files_of(records: Iterable[bytes], file_bytes: int, head) -> Iterator[pa.RecordBatch]:
    """Rows of one archive each; ``head(number)`` starts an archive."""
    parts, size, number = [], 0, 0
    for r in records:
        if parts and size + len(r) > file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])
            parts, size = [], 0
        if not parts:
            parts.append(head(number))
            number, size = number + 1, len(parts[0])
        parts.append(r)
        size += len(r)
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])


def write_files(archives: DataFrame, path: str, compression: str = "gzip") -> None:
    """One file for each row of ``archives(content binary)``."""
    (archives.select(F.col("content").cast("string")).write
     .option("maxRecordsPerFile", 1).option("compression", compression).text(path))


def write_warc(records: DataFrame, path: str, file_bytes: int = 16 << 20) -> None:
    """Write ``records`` (``RECORD`` and ``refers_to_id``) as WARC files; those that refer become revisits."""

    def serialise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for r in batch.to_pylist():
                    fields = [("WARC-Record-ID", f"<urn:uuid:{r['rec_id']}>"), ("WARC-Date", r["warc_date"]),
                              ("WARC-Target-URI", r["target_uri"]), ("Content-Type", r["content_type"]),
                              ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                              ("X-Payload-Bytes", str(r["payload_bytes"]))]
                    if r["refers_to_id"]:
                        yield warc_record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", REVISIT_PROFILE),
                                           ("WARC-Refers-To", f"<urn:uuid:{r['refers_to_id']}>")], r["http_header"])
                    else:
                        block = r["http_header"] + (r["payload"] or b"")
                        yield warc_record([("WARC-Type", r["warc_type"]), *fields,
                                           ("WARC-Block-Digest", f"sha1:{r['block_digest']}")], block)

        return files_of(rows(), file_bytes, lambda _: b"")

    write_files(records.mapInArrow(serialise, "content binary"), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    at = 0
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"WARC record at {at}: {lines[0][:100]!r}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4:end + 4 + size]
        at = end + 4 + size


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bare = lambda x: x[len("<urn:uuid:"):-1] if x else None
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for head, block in parse_warc(inflate(content.as_py())):
                http, payload = b"", block
                if block.startswith(b"HTTP/"):
                    http, sep, payload = block.partition(b"\r\n\r\n")
                    http += sep
                digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Bytes"])
                if head["WARC-Type"] != "revisit" and (len(payload), sha1_base32(payload)) != (size, digest):
                    raise ValueError(f"{head['WARC-Record-ID']}: the payload is not the one declared")
                rows.append((bare(head["WARC-Record-ID"]), head["WARC-Type"], head["WARC-Target-URI"],
                             head["WARC-Date"], bare(head.get("WARC-Refers-To")), http, size, digest))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string()])],
                    names=["rec_id", "warc_type", "target_uri", "warc_date", "refers_to_id", "http_header",
                           "payload_bytes", "payload_digest"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the WARC files in the folder ``path`` hold (schema ``READ``); response payloads are verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read, READ)
