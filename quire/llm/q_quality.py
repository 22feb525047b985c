"""Query of operator 13; SQL cannot train it, the tests measure it on held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stage, table
from quire.llm.quality import fit_quality, measured, scored

HELD_OUT = 2  # remainder of the ids' checksums by 4; these rows' labels are never read


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from three quarters of the labels."""
    rows = stage(measured(table(spark, sf_dir, "documents")), "measured")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit_quality(rows, labels, fold=remainder, trains=remainder != HELD_OUT)
    return scored(rows, model).select(
        "doc_id", F.coalesce(remainder == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
