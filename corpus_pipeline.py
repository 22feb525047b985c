"""From documents to packed training sequences.

``STAGES`` run in order; each takes what the one before kept, as Parquet
written to the shared folder and read again.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stage, table
from quire.llm.decontaminate import contaminated
from quire.llm.minhash import near_duplicates
from quire.llm.packing import pack
from quire.llm.q_toxicity import fit_on
from quire.llm.substrings import remove_repeated
from quire.llm.toxicity import without_rejected


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject as toxic."""
    return without_rejected(docs, fit_on(spark, docs, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least doc_id, of each group of near copies (five-word shingles, 0.8).

    Rows without a doc_id cannot be grouped and stay.  Rows of one doc_id with different texts are
    one node of the graph: if it is kept all of them stay, each text once.
    """
    named = docs.where("doc_id is not null")
    kept = near_duplicates(named, size=5, percent=80).where("kept").select("doc_id").distinct()
    return (named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
            .unionByName(docs.where("doc_id is null")))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows."""
    return remove_repeated(docs, window=35)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", decontaminate), ("packing", packing)]

#: SQL can train no classifier and knows no tokenizer; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
