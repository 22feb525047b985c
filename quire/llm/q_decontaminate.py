"""Query and SQL of operator 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table
from quire.llm.decontaminate import contaminated


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items each document holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The same aligned windows, all of them verified, without fingerprints.
ORACLE = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'),
    lambda x: x <> '') AS words FROM benchmark),
it AS (SELECT item_id, words, len(words) AS size, least(5, len(words)) AS k FROM iw WHERE len(words) > 0),
ig AS (
  SELECT item_id, size, k, i - 1 AS off, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM it)),
n AS (SELECT count(*) AS total FROM it),
gd AS (SELECT gram, round(1000 * ln(1 + total / count(DISTINCT item_id)))::BIGINT AS idf FROM ig, n GROUP BY gram, total),
iwt AS (SELECT item_id, gram, count(*) * idf AS w FROM ig JOIN gd USING (gram) GROUP BY item_id, gram, idf),
tot AS (SELECT item_id, sum(w) AS wi FROM iwt GROUP BY item_id),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+'),
    lambda x: x <> '') AS words FROM documents),
dg AS (
  SELECT doc_id, n, k, i - 1 AS pos, array_to_string(words[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, words, len(words) AS n, k, unnest(range(1, len(words) - k + 2)) AS i
        FROM dw, (SELECT DISTINCT k FROM it) WHERE len(words) >= k)),
hit AS (
  SELECT doc_id, item_id, size, ig.k, ig.gram, greatest(0, least(pos - off, n - size)) AS start
  FROM dg JOIN ig ON dg.gram = ig.gram AND dg.k = ig.k),
ok AS (
  SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, item_id, gram FROM hit) JOIN iwt USING (item_id, gram)
  JOIN tot USING (item_id) GROUP BY doc_id, item_id, wi HAVING 100 * sum(w) >= 80 * wi),
win AS (SELECT DISTINCT doc_id, item_id, size, k, start FROM hit JOIN ok USING (doc_id, item_id)),
wg AS (
  SELECT doc_id, item_id, start, array_to_string(ww[i:i + kk - 1], ' ') AS gram
  FROM (SELECT doc_id, item_id, start, ww, least(k, len(ww)) AS kk, unnest(range(1, len(ww) - least(k, len(ww)) + 2)) AS i
        FROM (SELECT doc_id, item_id, start, k, words[start + 1:start + size] AS ww FROM win JOIN dw USING (doc_id)))),
wt AS (
  SELECT doc_id, item_id, start, wg.gram, count(*) * coalesce(idf, round(1000 * ln(1 + total))::BIGINT) AS w
  FROM wg LEFT JOIN gd USING (gram), n GROUP BY doc_id, item_id, start, wg.gram, idf, total),
sm AS (
  SELECT doc_id, item_id, start, sum(wt.w) AS wd, sum(least(wt.w, coalesce(iwt.w, 0))) AS common
  FROM wt LEFT JOIN iwt USING (item_id, gram) GROUP BY ALL)
SELECT doc_id, item_id, min(start)::BIGINT AS start, max(common / (wd + wi - common)) AS similarity
FROM sm JOIN tot USING (item_id) WHERE 100 * common >= 80 * (wd + wi - common) GROUP BY doc_id, item_id
"""
