"""Running sums over sorted distinct values, by range partitions.

A column's distinct values are laid out in ranges of about ``PART_ROWS`` rows, so
their number follows from the data.  Equal values stay together.  The sums of the
ranges, a few rows, get a window of their own; what lies before a range is then
added to the running sums inside it.  No task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

PART_ROWS = 250_000
PART = "_part"


def lay_out(df: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with a range number ``PART`` that rises with the columns ``order``; ties share one.

    The rows are checkpointed: a range must not change when a lost task runs again.
    """
    held = cut_lineage(df)
    parts = -(-held.count() // part_rows)
    if parts <= 1:
        return held.withColumn(PART, F.lit(0))
    return cut_lineage(held.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def sums_before(totals: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``totals(PART, by.., columns..)`` with each column replaced by its sum over the earlier ranges."""
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(PART, *by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in columns])


def prefix_sums(df: DataFrame, by: list[str], order: str, columns: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with ``{c}_below``: the sum of ``c`` over rows of the same ``by`` group with a smaller ``order``.

    One row for each (by, order); ``by`` holds no nulls.
    """
    laid = lay_out(df, [*by, order], part_rows)
    totals = laid.groupBy(PART, *by).agg(*[F.sum(c).alias(c) for c in columns])
    before = sums_before(totals, by, columns)
    for c in columns:
        before = before.withColumnRenamed(c, f"_before_{c}")
    inside = Window.partitionBy(PART, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return laid.join(before, [PART, *by]).select(
        *df.columns, *[(F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below") for c in columns])
