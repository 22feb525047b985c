"""Helpers shared by the training-data operators: staging, words, components."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``sf_dir``, read by Spark from whatever store it lies in."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks it was running.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Hand freed memory back to the system: Python workers outlive a task and serve later stages beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` over a partition's batches, after which freed memory goes back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; ``bytes`` methods
    know only ASCII, so just A-Z is lower-cased and just those six bytes split."""
    raw = (text or "").encode("utf-8")
    return (raw.lower() if lower else raw).split()


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace a partition's edges by (node, least node of its local group)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i:i + 50_000]
        yield pd.DataFrame({"src": np.array(part, dtype="int64"),
                            "dst": np.array([find(x) for x in part], dtype="int64")})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(src long, dst long)``.

    Returns ``(node, component)`` with the least node of each component, for
    every node that has an edge.  Each partition first contracts its own edges
    (one row per node, whatever the number of edges), then large-star and
    small-star rounds alternate over staged tables until nothing changes.
    All minima are partial aggregates, so a node with very many edges does not
    gather them in one task.
    """
    spark = edges.sparkSession
    forest = edges.where("src <> dst").select("src", "dst").mapInPandas(_local_forest, "src long, dst long")
    cur = stage(forest.distinct(), "cc")
    while True:
        # Large star: every node hands its larger neighbours to the least one it knows.
        both = cur.select("src", "dst").unionByName(cur.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = (both.where("dst > src").join(least, "src")
                 .select(F.col("dst").alias("src"), F.col("m").alias("dst")))
        # Small star on the result: smaller neighbours are linked to their least one.
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = (large.join(low, "src")
                 .select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")),
                                           F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
                 .select("e.src", "e.dst").where("src <> dst").distinct())
        nxt = stage(small, "cc")
        # A star forest: no source has two targets and no target is a source.
        state = nxt.select(
            F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("s")).first()
        if state["n"] == state["s"] and nxt.join(nxt.select(F.col("dst").alias("src")), "src", "left_semi").isEmpty():
            return nxt.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
                nxt.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        cur = nxt
