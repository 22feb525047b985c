"""Query and SQL of operator 11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.periodic_runs import periodic_runs


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; by the checksum of its id, about a tenth of the texts repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    i = lambda x: F.when(x < a, x).otherwise(a + (x - a) % p)
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")),
                                     lambda x: F.get("words", i(x).cast("int"))), " ")
    return (docs.select("doc_id", "text", h.alias("h"))
            .withColumn("words", F.when(F.col("h") % 10 == 0, words))
            .select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), again).otherwise(F.col("text")).alias("text")))


def strongest(runs: Column) -> Column:
    """The run of greatest length/period; of equals the first, then that of least period."""
    def order(x: Column, y: Column) -> Column:
        more = x["length"] * y["period"] - y["length"] * x["period"]
        return (F.when(more != 0, -F.signum(more)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]))
                .otherwise(F.signum(x["period"] - y["period"]))).cast("int")

    return F.get(F.array_sort(runs, order), F.lit(0))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document, as counts and digests."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), shortest=24, times=3)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


#: Every stretch of words equal to those d further on holds nine or more pairs of
#: equal 8-word sequences in a row, so islands of such pairs give all runs.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, c: xor(x >> 8, list_reduce(list_prepend(xor(x, c) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS inv
  FROM documents),
g AS (SELECT doc_id, o, len(o)::BIGINT AS n, xor(inv, 4294967295) AS h, xor(inv, 4294967295) // 10 AS g FROM w),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words
  FROM p),
k AS (SELECT doc_id, n, i, md5(array_to_string(words[i + 1:i + 8], ' ')) AS k FROM (SELECT *, unnest(range(0, n - 7)) AS i FROM d WHERE n >= 24)),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
t AS (SELECT doc_id, q, min(i) AS start, max(i) + 8 + q - min(i) AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM t WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
b AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM r GROUP BY doc_id),
f AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
e AS (SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM d),
z AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.i = e.i WHERE c.i IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN z USING (doc_id)
"""
