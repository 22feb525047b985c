"""Query and SQL of operator 10."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import warc
from quire.llm.common import shared_path, stage, table


def _as_arc(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stand-in input: pages as ARC files, version 1 and 2 by turns."""
    task = TaskContext.get().partitionId()
    version = 1 + task % 2

    def head(number: int) -> bytes:
        body = f"{version} 0 crawl\n{warc.ARC_FIELDS[version]}\n".encode()
        return f"filedesc://pages-{task:06d}-{number:06d}.arc 0.0.0.0 20250102030405 text/plain {len(body)}\n".encode() + body + b"\n"

    def rows():
        for batch in batches:
            for r in batch.to_pylist():
                html = (r["html"] or "").encode("utf-8")
                key = "" if r["page_id"] is None else f"X-Page-Id: {r['page_id']}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}\r\n".encode() + html
                url = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode())
                              for c in r["url"] or "unknown:")
                more = " 200 - - 0 pages.arc" if version == 2 else ""
                yield f"{url} 0.0.0.0 20250102030405 text/html{more} {len(body)}\n".encode() + body + b"\n"

    return warc.files_of(rows(), 16 << 20, head)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC files and read back.

    Pages are keyed by an HTTP header of their record.  A null page_id sorts
    first among equal payloads.
    """
    page_id = F.expr(r"try_cast(nullif(regexp_extract(cast(http_header as string), 'X-Page-Id: (-?[0-9]+)', 1), '') as bigint)")
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    warc.write_files(pages.mapInArrow(_as_arc, "content binary"), arcs)

    records = warc.convert_arcs(spark, arcs)
    keys = stage(records.where("warc_type = 'response'")
                 .select("rec_id", page_id.alias("page_id"), "payload_bytes", "payload_digest"), "arc-keys")
    refers = warc.first_of_payload(keys, "page_id", min_bytes=0)
    warc.write_warc(records.join(refers, "rec_id", "left"), warcs)

    back = stage(warc.read_warc(spark, warcs).where("warc_type in ('response', 'revisit')")
                 .select("rec_id", "warc_type", "refers_to_id", page_id.alias("page_id"), "payload_bytes",
                         "payload_digest"), "warc-read")
    stands = back.where("warc_type = 'response'").select(
        F.col("rec_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return (back.join(stands, "refers_to_id", "left")
            .select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         bit_count(0) AS z, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT
        + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS f FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to
FROM m
"""
