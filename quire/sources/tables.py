"""Parquet table access.

Readers return lazy DataFrames; projections and filters applied afterwards
reach the scan (``PushedFilters`` / pruned ``ReadSchema``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_jdbc(spark: SparkSession, url: str, dbtable: str, *, partition_column: str | None = None,
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int | None = None, fetchsize: int = 10000,
              properties: dict | None = None) -> DataFrame:
    """S2 chunked scan: a JDBC read split into ``num_partitions`` range queries.

    Credentials come from the caller / Spark conf only.  Each partition is
    one range query on ``partition_column``; the union of partitions is the
    whole table, so the result equals the unsplit read.
    """
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", dbtable)
              .option("fetchsize", str(fetchsize)))
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partitioned read needs lower_bound, upper_bound, num_partitions")
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()
