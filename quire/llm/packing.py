"""Sequence packing by cutting-stock column generation (operator 9).

Documents are cut into full sequences and one shorter rest each.  Rests are
counted by length in units of ``unit`` tokens, rounded up; that histogram (at
most ``capacity / unit`` rows, whatever the corpus) goes to the driver, where a linear program over patterns (how often each length occurs
in one sequence) is solved by column generation: a knapsack dynamic program
over the duals prices new patterns until none improves or the bound is within
``gap``.  Patterns are used as often as their rounded-down solution says; what
is left (at most a few pieces per pattern) is filled sequence by sequence with
the subset of lengths that fills best.

Pieces are ranked within their class by a hash bucket and a row number inside
it, so a length that a third of all pieces share is not sorted by one task.
The k-th piece of a class takes the k-th place that the patterns hold for it;
offsets then add up the true lengths of a sequence.

Defined cases: a null text has only its end id; rows with equal doc_id are
packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage
from quire.llm.tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces (schema ``PIECE``) of ``docs(doc_id, text)``: full ones of ``capacity`` ids and one rest."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            texts = (text.as_py() for text in batch.column("text"))
            for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(texts)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    rows.append((key, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[
                    "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def price(duals: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most dual value within ``capacity`` (knapsack with repetition)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        best[c], last[c] = best[c - 1], -1
        if n:
            gain = best[c - lengths[:n]] + duals[:n]
            i = n - 1 - int(gain[::-1].argmax())  # of equals the longest
            if gain[i] > best[c] + 1e-12:
                best[c], last[c] = gain[i], i
    pattern, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= lengths[last[c]]
    return best[capacity], pattern


def starting_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A feasible basis and its inverse.

    Each pattern holds the longest length left, fills up with others, and is
    used until one of its lengths runs out.  Later patterns lack that length,
    so the patterns are triangular and inverted row by row.
    """
    left, patterns, order = demand.copy(), [], []
    open_ = np.ones(len(lengths), dtype=bool)
    while open_.any():
        index = np.nonzero(open_)[0]
        pattern = np.zeros(len(lengths))
        pattern[index[-1]] = 1
        fill = price(lengths[index].astype("float64"), lengths[index], capacity - int(lengths[index[-1]]))[1]
        pattern[index] += fill
        some = np.where(pattern > 0, left / np.where(pattern > 0, pattern, 1), np.inf)
        out = int(some.argmin())
        left = np.maximum(left - some[out] * pattern, 0)
        open_[out] = False
        patterns.append(pattern)
        order.append(out)
    lower = np.array(patterns).T[order]
    inverse = np.zeros_like(lower)
    for t in range(len(order)):
        row = -(lower[t, :t, None] * inverse[:t]).sum(axis=0)
        row[order[t]] += 1
        inverse[t] = row / lower[t, t]
    return patterns, inverse


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float,
          most_columns: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) use by column generation on a dense basis inverse.

    ``lengths`` ascend.  Ends when the sum of uses is within ``gap`` of the
    dual bound, or after ``most_columns`` columns (the patterns are then
    feasible but may be further from it).
    """
    basis, inverse = starting_basis(lengths, demand, capacity)
    use = np.maximum(inverse @ demand, 0)
    for _ in range(most_columns):
        duals = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = price(duals, lengths, capacity)
        if value <= 1 + 1e-9 or use.sum() <= (1 + gap) * max((duals @ demand) / value, (lengths @ demand) / capacity):
            break
        step = inverse @ pattern
        rising = step > 1e-10
        ratio = np.where(rising, use / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[out] = pattern
        inverse[out] /= step[out]
        rest = step.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
    return [(p, float(x)) for p, x in zip(basis, use)]


def best_filling(items: list[int], room: int) -> list[int]:
    """Indices of ``items`` whose sum is the largest that is at most ``room``."""
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in items:
        reach.append((reach[-1] | reach[-1] << x) & mask)
    target, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(items) - 1, -1, -1):
        if not reach[i] >> target & 1:
            chosen.append(i)
            target -= items[i]
    return chosen


def plan_sequences(histogram: dict[int, int], capacity: int, gap: float = 1e-3,
                   most_columns: int = 1500) -> list[tuple[list[tuple[int, int]], int]]:
    """``[([(length, count), ...], copies), ...]`` that uses each length as often as ``histogram`` says."""
    left = {k: v for k, v in sorted(histogram.items()) if 0 < k < capacity and v > 0}
    plan: list[tuple[list[tuple[int, int]], int]] = []
    if histogram.get(capacity):
        plan.append(([(capacity, 1)], histogram[capacity]))
    if not left:
        return plan
    lengths = np.array(list(left), dtype="int64")
    solution = solve(lengths, np.array(list(left.values()), dtype="float64"), capacity, gap, most_columns)
    for pattern, use in sorted(solution, key=lambda s: -s[1]):
        items = [(int(lengths[i]), int(pattern[i])) for i in np.nonzero(pattern)[0]]
        copies = min([int(use + 1e-6), *(left[k] // n for k, n in items)]) if items else 0
        if copies > 0:
            plan.append((items, copies))
            for k, n in items:
                left[k] -= n * copies
    rest = sorted((k for k, n in left.items() for _ in range(n)), reverse=True)
    while rest:
        first, others = rest[0], rest[1:]
        chosen = set(best_filling(others, capacity - first))
        items: dict[int, int] = {first: 1}
        for i in chosen:
            items[others[i]] = items.get(others[i], 0) + 1
        plan.append((sorted(items.items()), 1))
        rest = [x for i, x in enumerate(others) if i not in chosen]
    return plan


def places(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, first rank, rank after, count per sequence, first sequence, place there) of ``plan``."""
    rows, taken, sequence = [], {}, 0
    for items, copies in plan:
        for place, (size, count) in enumerate(items):
            at = taken.get(size, 0)
            rows.append((size, at, at + count * copies, count, sequence, place))
            taken[size] = at + count * copies
        sequence += copies
    return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, unit: int = 4, gap: float = 1e-3,
         bucket_rows: int = 50_000) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its ``sequence_id`` and ``offset`` there."""
    if capacity % unit:
        raise ValueError("unit must divide capacity")
    spark = docs.sparkSession
    pieces = stage(cut_documents(docs, tokenizer, end_id, capacity)
                   .withColumn("size", F.ceil(F.col("length") / unit)), "pieces")
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(histogram.values()) // bucket_rows))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (keyed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
            .select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("size", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (keyed.withColumn("row", F.row_number().over(inside) - 1).join(base, ["size", "bucket"])
              .withColumn("rank", F.col("base") + F.col("row")))
    # A few rows for each size, so bounded by the capacity and not by the corpus.
    table = spark.createDataFrame(places(plan_sequences(histogram, capacity // unit, gap)),
                                  "size long, first long, after long, count long, sequence long, place long")
    fits = ((ranked["size"] == table["size"]) & (ranked["rank"] >= table["first"]) & (ranked["rank"] < table["after"]))
    nth = F.col("rank") - F.col("first")
    placed = (ranked.join(F.broadcast(table), fits)
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("sequence") + F.floor(nth / F.col("count"))).cast("long").alias("sequence_id"),
                      "place", F.pmod(nth, F.col("count")).alias("slot")))
    earlier = (Window.partitionBy("sequence_id").orderBy("place", "slot")
               .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
            .drop("place", "slot"))
