"""Query of operator 12; SQL has no eigenvectors, the tests compare with plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.whitening import whiten


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every vector; the 100,000 that the integers are shifted by cancels throughout."""
    return whiten(table(spark, sf_dir, "embeddings"), scale=1024, components=8)
