"""Token-id files of patched frame-of-reference blocks (operator 5).

Ids are written in blocks of ``BLOCK`` values.  A block stores its minimum,
a bit width chosen at a percentile of its differences to the minimum, the low
bits of all differences packed at that width, and an exception list (position
and high bits) for the differences that need more.  A segment (one file) holds
whole documents: document index, then minima, widths, exception counts and the
start of every block, then the blocks, then a CRC-32.  Any block can be decoded
alone through the block starts.

The corpus is range-partitioned on the key before it is encoded, so texts move
once and segments come out in key order; a task holds one segment's ids
(``segment_tokens``, or one longer document).  Starts over the whole corpus are
two prefix sums: over segments inside a task's output, and over the tasks.

Defined cases: a null text is empty and yields only the end id; null keys come
first; rows with equal keys are ordered by text; no rows give no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stage
from quire.llm.tokens import encoder

BLOCK = 128
HEAD = struct.Struct("<4sIQQQQQ")  # magic, block size, task, number, documents, ids, blocks
MAGIC = b"PFR1"
CHUNK = 4096  # blocks unpacked to single bits at a time


def _width(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(x == 0, 0, np.floor(np.log2(np.maximum(x, 1).astype("float64"))).astype("int64") + 1)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[bytes, bytes]:
    """(index, data) of ``ids`` (uint32): minima, widths, exception counts, starts; and the blocks."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return struct.pack("<Q", 0), b""
    padded = np.full(n_blocks * BLOCK, ids[-1], dtype="uint32")
    padded[:len(ids)] = ids
    values = padded.reshape(n_blocks, BLOCK)
    low = values.min(axis=1)
    diff = values - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _width(np.partition(diff, at, axis=1)[:, at])
    block, pos = np.nonzero(diff.astype("uint64") >> width[:, None].astype("uint64"))
    high = (diff[block, pos].astype("uint64") >> width[block].astype("uint64")).astype("<u4")
    n_exc = np.bincount(block, minlength=n_blocks)
    packed = width * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(packed + 5 * n_exc)]).astype("<u8")
    data = np.zeros(int(starts[-1]), dtype="uint8")
    begin = starts[:-1].astype("int64")
    for w in np.unique(width[width > 0]):
        for rows in np.array_split(np.nonzero(width == w)[0], -(-int((width == w).sum()) // CHUNK)):
            bits = ((diff[rows][:, :, None] >> np.arange(w, dtype="uint32")) & 1).astype("uint8")
            data[begin[rows][:, None] + np.arange(packed[rows[0]])] = np.packbits(
                bits.reshape(len(rows), -1), axis=1, bitorder="little")
    if len(block):
        rank = np.arange(len(block)) - np.concatenate([[0], np.cumsum(n_exc)])[block]
        lists = begin[block] + packed[block]
        data[lists + rank] = pos
        data[(lists + n_exc[block] + 4 * rank)[:, None] + np.arange(4)] = high.view("uint8").reshape(-1, 4)
    index = low.astype("<u4").tobytes() + width.astype("uint8").tobytes() + n_exc.astype("uint8").tobytes() + starts.tobytes()
    return index, data.tobytes()


def unpack_blocks(index: bytes, data: bytes, n_blocks: int, n_ids: int) -> np.ndarray:
    """The ids that ``pack_blocks`` packed."""
    low = np.frombuffer(index, "<u4", n_blocks)
    width = np.frombuffer(index, "uint8", n_blocks, 4 * n_blocks).astype("int64")
    n_exc = np.frombuffer(index, "uint8", n_blocks, 5 * n_blocks).astype("int64")
    starts = np.frombuffer(index, "<u8", n_blocks + 1, 6 * n_blocks).astype("int64")
    raw, packed = np.frombuffer(data, "uint8"), width * (BLOCK // 8)
    diff = np.zeros((n_blocks, BLOCK), dtype="uint32")
    for w in np.unique(width[width > 0]):
        for rows in np.array_split(np.nonzero(width == w)[0], -(-int((width == w).sum()) // CHUNK)):
            bits = np.unpackbits(raw[starts[rows][:, None] + np.arange(packed[rows[0]])], axis=1, bitorder="little")
            bits = bits.reshape(len(rows), BLOCK, w).astype("uint32") << np.arange(w, dtype="uint32")
            diff[rows] = bits.sum(axis=2, dtype="uint32")
    if n_exc.any():
        block = np.repeat(np.arange(n_blocks), n_exc)
        rank = np.arange(len(block)) - np.concatenate([[0], np.cumsum(n_exc)])[block]
        lists = starts[block] + packed[block]
        high = raw[(lists + n_exc[block] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        diff[block, raw[lists + rank]] |= (high.astype("uint64") << width[block].astype("uint64")).astype("uint32")
    return (diff + low[:, None]).reshape(-1)[:n_ids]


def write_segment(task: int, number: int, keys: list, docs: list[np.ndarray], percentile: float) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, "uint32")
    index, data = pack_blocks(ids, percentile)
    body = b"".join([
        HEAD.pack(MAGIC, BLOCK, task, number, len(docs), len(ids), -(-len(ids) // BLOCK)),
        np.array([k is not None for k in keys], dtype="uint8").tobytes(),
        np.array([k or 0 for k in keys], dtype="<i8").tobytes(),
        np.array([len(d) for d in docs], dtype="<u8").tobytes(), index, data])
    return body + struct.pack("<I", zlib.crc32(body))


def read_segment(raw: bytes) -> tuple[int, int, list, list[np.ndarray]]:
    """(task, number, keys, ids of each document) of one segment; bytes after it are ignored."""
    magic, block, task, number, n_docs, n_ids, n_blocks = HEAD.unpack_from(raw)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a token segment")
    at = HEAD.size
    valid = np.frombuffer(raw, "uint8", n_docs, at)
    keys = np.frombuffer(raw, "<i8", n_docs, at + n_docs)
    sizes = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs)
    at += 17 * n_docs
    index = raw[at:at + 14 * n_blocks + 8]
    at += len(index)
    size = struct.unpack_from("<Q", index, 14 * n_blocks)[0]
    if zlib.crc32(raw[:at + size]) != struct.unpack_from("<I", raw, at + size)[0]:
        raise ValueError("a token segment is damaged")
    ids = unpack_blocks(index, raw[at:at + size], n_blocks, n_ids)
    docs = np.split(ids, np.cumsum(sizes)[:-1].astype("int64")) if n_docs else []
    return task, number, [int(k) if v else None for k, v in zip(keys, valid)], docs


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, segment_tokens: int = 4 << 20,
                      percentile: float = 0.9) -> None:
    """Encode ``docs(doc_id, text)``, append ``end_id`` to each, and write segments in ascending doc_id order."""

    def segments(batches: Iterable[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        number, keys, held, size = 0, [], [], 0
        for batch in batches:
            texts = (text.as_py() for text in batch.column("text"))
            for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("uint32")
                if held and size + len(ids) > segment_tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([write_segment(task, number, keys, held, percentile)], pa.binary())], names=["content"])
                    number, keys, held, size = number + 1, [], [], 0
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([write_segment(task, number, keys, held, percentile)], pa.binary())], names=["content"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long"), "text")
               .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))
    # Spark's text writer puts one line feed after the segment.
    (ordered.mapInArrow(segments, "content binary").select(F.col("content").cast("string"))
     .write.option("maxRecordsPerFile", 1).text(path))


def _docs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            task, number, keys, docs = read_segment(content.as_py())
            sizes = np.array([len(d) for d in docs], dtype="int64")
            yield pa.RecordBatch.from_arrays([
                pa.array([task] * len(docs), pa.int64()), pa.array([number] * len(docs), pa.int64()),
                pa.array(keys, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64())],
                names=["task", "number", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = stage(files.select("content").mapInArrow(
        _docs_of, "task long, number long, doc_id long, local_start long, n_tokens long, ids_crc32 long"), "token-docs")
    segments = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the writer: as many as the shuffle has partitions.
    over = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = (segments.groupBy("task").agg(F.sum("n").alias("n"))
             .select("task", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("task_start")))
    starts = (segments.select("task", "number", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("segment_start"))
              .join(tasks, "task"))
    return (rows.join(starts, ["task", "number"])
            .select("doc_id", (F.col("task_start") + F.col("segment_start") + F.col("local_start")).alias("start"),
                    "n_tokens", "ids_crc32"))
