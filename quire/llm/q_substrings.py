"""Query and SQL of operator 8."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.substrings import digest_removals, repeated_passages


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated 35-word windows."""
    small, removals = repeated_passages(table(spark, sf_dir, "documents"), window=35)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    lost = digest_removals(removals).withColumnsRenamed({"doc_id": "d", "key": "k"})
    return (small.join(lost, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
            .select("doc_id", "n_words",
                    F.when(F.col("gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                    F.when(F.col("gone"), nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256")))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS st, words FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, st, md5(array_to_string(words[st:st + 34], ' ')) AS k FROM s),
r AS (SELECT doc_id, st FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(st, st + 35)) AS pos FROM r),
p AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.pos = p.i
  WHERE c.pos IS NULL GROUP BY p.doc_id),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
