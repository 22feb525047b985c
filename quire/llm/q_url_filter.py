"""Query and SQL of operator 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.url_filter import judge_urls

#: Fixed values of the task.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url.

    The tables hold no outcomes of pages, so ``labels.quality`` of the same id
    stands in for them (0: bad).
    """
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes, RULES)


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM r),
d AS (
  SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p),
dom AS (
  SELECT host, string_split(bare, '.')[-1] AS suffix,
         CASE WHEN len(string_split(bare, '.')) > 1
              THEN string_split(bare, '.')[-2] || '.' || string_split(bare, '.')[-1] ELSE bare END AS domain FROM d),
h AS (
  SELECT dom.host, domain, suffix, count(l.quality) AS n, coalesce(sum(1 - l.quality), 0) AS bad
  FROM dom JOIN p USING (host) LEFT JOIN labels l ON l.doc_id = p.page_id GROUP BY ALL),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
sf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY ALL),
lv AS (
  SELECT 'h' AS lv, n, bad FROM h WHERE n > 0 UNION ALL SELECT 'd', n, bad FROM dm WHERE n > 0
  UNION ALL SELECT 's', n, bad FROM sf WHERE n > 0),
st AS (
  SELECT lv, sum(n)::DOUBLE AS n, sum(bad) / sum(n) AS q, count(*) AS g, sum(n * n) AS nn, sum(bad * bad / n) AS bb
  FROM lv GROUP BY lv),
mo AS (
  SELECT lv, q * (1 - q) * (n - nn / n - (g - 1)) AS room, (bb - n * q * q) - q * (1 - q) * (g - 1) AS btw FROM st),
k AS (
  SELECT lv, CASE WHEN room <= 0 OR btw <= 0 THEN 1000.0::DOUBLE
                  ELSE least(1000.0::DOUBLE, greatest(2.0::DOUBLE, room / btw - 1)) END AS k FROM mo),
c AS (
  SELECT coalesce((SELECT k FROM k WHERE lv = 'h'), 1000) AS kh, coalesce((SELECT k FROM k WHERE lv = 'd'), 1000) AS kd,
         coalesce((SELECT k FROM k WHERE lv = 's'), 1000) AS ks,
         (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) FROM sf) AS o),
s1 AS (SELECT suffix, (bad + ks * o) / (n + ks) AS r FROM sf, c),
d1 AS (SELECT domain, (bad + kd * r) / (n + kd) AS r FROM dm JOIN s1 USING (suffix), c),
h1 AS (SELECT host, (bad + kh * r) / (n + kh) AS m, n + kh AS sz FROM h JOIN d1 USING (domain), c),
h2 AS (SELECT host, m - 1.645 * sqrt(m * (1 - m) / (sz + 1)) >= 0.2 AS blocked FROM h1),
w AS (
  SELECT page_id, host, path, blocked,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN h2 USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM w
"""
