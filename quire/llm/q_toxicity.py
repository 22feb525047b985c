"""Query of operator 3; SQL cannot train the chain, the tests measure it on held-out labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.toxicity import Chain, fit_chain, score

#: ``labels`` holds these two; low quality is judged first and feeds the toxic model.
CATEGORIES = ("low_quality", "toxic")


def fit_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return fit_chain(docs, labels, CATEGORIES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_on(spark, docs, sf_dir))
