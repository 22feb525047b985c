"""Query of operator 5; SQL cannot tokenize, the tests compare with a plain version."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import shared_path, table
from quire.llm.token_files import read_token_files, write_token_files


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files of patched frame-of-reference blocks, read back."""
    path = shared_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)
