"""Query and SQL of operator 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.embeddings import near_vectors


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and a cosine of 0.98 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) g ON g.a = e.vec_id
"""
