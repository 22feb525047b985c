"""Query of operator 7; SQL cannot parse pages, the tests compare with known articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.html_text import extract


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
