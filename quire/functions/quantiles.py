"""Exact quantiles of continuous columns without one task holding a column."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values of a bracket this small are counted one by one.
HELD_ROWS = 4096
# A bracket is cut into at most this many cells, as a power of two.
CELL_BITS = 11

#: Key range of all doubles: their bits as integers that sort as the doubles do.
EVERYTHING = (-2 ** 63, 2 ** 63 - 1)
CELL = "bracket int, cell long, n long, low long, high long"


def _keys(x: np.ndarray) -> np.ndarray:
    bits = (x + 0.0).view("int64")  # -0.0 is 0.0
    return bits ^ ((bits >> 63) & np.int64(2 ** 63 - 1))


def _value(key: int) -> float:
    k = np.array([key], dtype="int64")
    return float((k ^ ((k >> 63) & np.int64(2 ** 63 - 1))).view("float64")[0])


def _merged(cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Entries of one cell added up; a cell's entries need not be neighbours."""
    order = np.argsort(cell, kind="stable")
    cell, n, low, high = (a[order] for a in (cell, n, low, high))
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[at], np.add.reduceat(n, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


def _cells(df: DataFrame, columns: list[str], brackets: list[tuple]) -> DataFrame:
    """Rows (schema ``CELL``) of every bracket ``(column index, low key, high key, rows inside)``: its cells in the
    order of their values, with the number of values and the least and greatest key in each.

    A task adds its batches up as arrays and hands on at most ``2 ** (CELL_BITS + 1)`` cells a bracket."""
    by_column: dict = {}
    for b, (i, low, high, rows) in enumerate(brackets):
        span = (high - low).bit_length()
        shift = None if rows is not None and rows <= HELD_ROWS else max(0, span - (12 if span == 64 else CELL_BITS))
        by_column.setdefault(i, []).append((b, low, high, shift))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for i, cuts in by_column.items():
                x = batch.column(i).to_numpy(zero_copy_only=False)
                seen, n = np.unique(_keys(x[~np.isnan(x)]), return_counts=True)
                for b, low, high, shift in cuts:
                    at, to = np.searchsorted(seen, low), np.searchsorted(seen, high, side="right")
                    if at == to:
                        continue
                    k = seen[at:to]
                    cell = k if shift is None else (
                        (k.view("uint64") - np.uint64(low % 2 ** 64)) >> np.uint64(shift)).astype("int64")
                    part = (cell, n[at:to], k, k)
                    if b in sums:
                        part = tuple(np.concatenate(p) for p in zip(sums[b], part))
                    sums[b] = _merged(*part)
        for b, (cell, n, low, high) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), b), pa.int32()), *[pa.array(a, pa.int64()) for a in (cell, n, low, high)]],
                names=["bracket", "cell", "n", "low", "high"])

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(count, CELL)
    return rows.groupBy("bracket", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def exact_quantiles(df: DataFrame, columns: list[str], probs: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of every column, NULL and NaN aside.

    Each order statistic that is needed keeps a bracket of values that holds it, at first all doubles.  A pass over
    the data counts the cells of all brackets; the cell that reaches the rank is the next bracket,
    until it holds one value.  A pass cuts a bracket's key range by ``2 ** CELL_BITS``, so there are at most six, and
    three or so where values are few or brackets soon small.  Only counts are shuffled, and only the
    cells that are reached go to the driver.
    """
    of_column = Window.partitionBy("bracket")
    upto = F.sum("n").over(of_column.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))

    def reached(brackets, ranks: str) -> list:
        """The cells that hold one of a bracket's ``ranks``, SQL for an array of numbers from 0."""
        return (_cells(df, columns, brackets).withColumn("upto", upto).withColumn("total", F.sum("n").over(of_column))
                .where(F.expr(f"exists({ranks}, r -> r < upto AND r >= upto - n)")).collect())

    asked = ", ".join(f"{p!r}D * (total - 1)" for p in probs)
    todo: dict = {}  # bracket -> the ranks in it, counted in the whole column
    total, found = {}, {}

    def settle(i: int, below: int, cells: list, ranks: Iterable[int]) -> None:
        for r in ranks:
            c = next(c for c in cells if c["upto"] - c["n"] <= r - below < c["upto"])
            if c["low"] == c["high"]:
                found[i, r] = _value(c["low"])
            else:
                todo.setdefault((i, c["low"], c["high"], c["n"], below + c["upto"] - c["n"]), set()).add(r)

    def grouped(rows) -> dict:
        out: dict = {}
        for r in rows:
            out.setdefault(r["bracket"], []).append(r)
        return out

    first = grouped(reached([(i, *EVERYTHING, None) for i in range(len(columns))], "flatten(transform(array("
                            f"{asked}), p -> array(floor(p), ceil(p))))")) if columns and probs else {}
    for i, cells in first.items():
        total[i] = cells[0]["total"]
        settle(i, 0, cells, {f(p * (total[i] - 1)) for p in probs for f in (floor, ceil)})
    while todo:
        open_, todo = list(todo.items()), {}
        ranks = ", ".join(f"{b}, array({', '.join(f'{r - k[4]}L' for r in sorted(rs))})" for b, (k, rs) in enumerate(open_))
        got = grouped(reached([k[:4] for k, _ in open_], f"element_at(map({ranks}), bracket)"))
        for b, (k, rs) in enumerate(open_):
            settle(k[0], k[4], got[b], rs)

    def quantile(i: int, p: float) -> float | None:
        if i not in total:
            return None
        at = p * (total[i] - 1)
        low, high = found[i, floor(at)], found[i, ceil(at)]
        return low if low == high else (ceil(at) - at) * low + (at - floor(at)) * high

    return {c: [quantile(i, p) for p in probs] for i, c in enumerate(columns)}
