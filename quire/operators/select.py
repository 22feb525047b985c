"""Feature selection over small statistic tables.

Inputs are correlation / importance tables with one row per feature, so
their size is bounded by the number of columns, never by the data.
Ties break on the feature name so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.stats import corr_from_gram, gram


def top_by(corr: DataFrame, column: str, n: int) -> DataFrame:
    """T1 (spearman) / T2 (pearson): the n most positive (descending) then
    the n most negative (still in descending order); zeros and NULLs are
    excluded.  Adds ``position`` (1-based order of the selected list)."""
    pos = corr.where(F.col(column) > 0).orderBy(F.desc(column), "feature").limit(n)
    neg = corr.where(F.col(column) < 0).orderBy(F.asc(column), "feature").limit(n)
    both = pos.withColumn("_s", F.lit(0)).unionByName(neg.withColumn("_s", F.lit(1)))
    return both.select("feature", column,
                       # at most 2n rows: a global window is fine here
                       F.row_number().over(Window.orderBy("_s", F.desc(column), "feature"))
                       .alias("position"))


def correlated_pairs(spark, df: DataFrame, features: list[str], threshold: float = 0.7) -> list:
    """Pairs (i < j in column order) with |r| > threshold, from one Gram pass."""
    g = gram(df, features)
    r = corr_from_gram(g)
    out = []
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            if abs(r[i, j]) > threshold:
                out.append((features[i], features[j], float(r[i, j])))
    return out, {f: float(g["cov"][k, k]) for k, f in enumerate(features)}


def filter_correlated(spark, df: DataFrame, features: list[str], threshold: float = 0.7) -> list[str]:
    """Walk the high-|r| pairs in column order; when neither member is
    dropped yet, drop the lower-variance one (tie -> the first).  The walk
    is over the p x p statistic, not over data."""
    pairs, var = correlated_pairs(spark, df, features, threshold)
    dropped: set = set()
    for a, b, _ in pairs:
        if a not in dropped and b not in dropped:
            dropped.add(b if var[a] > var[b] else a)
    return [f for f in features if f not in dropped]


def select_uncorrelated_top(spark, df: DataFrame, corr: DataFrame, n: int = 10,
                            threshold: float = 0.7) -> list[str]:
    """T4: T1 candidates -> T3 filter -> first n."""
    cand = [r["feature"] for r in top_by(corr, "spearman", n).orderBy("position").collect()]
    if not cand:
        return []
    return filter_correlated(spark, df, cand, threshold)[:n]


def chart_data(corr: DataFrame, k: int = 10) -> DataFrame:
    """Bar-chart rows (NULL -> 0): top k positive and last k negative
    Pearson; when every value is >= 0 the top k, when every value is <= 0
    the bottom k."""
    c = corr.select("feature", F.coalesce("pearson", F.lit(0.0)).alias("pearson"),
                    F.coalesce("spearman", F.lit(0.0)).alias("spearman"))
    flags = c.agg(F.min("pearson").alias("lo"), F.max("pearson").alias("hi")).first()
    if flags["lo"] is None:
        return c.limit(0)
    if flags["lo"] >= 0:
        return c.orderBy(F.desc("pearson"), "feature").limit(k)
    if flags["hi"] <= 0:
        return c.orderBy(F.asc("pearson"), "feature").limit(k)
    pos = c.where(F.col("pearson") > 0).orderBy(F.desc("pearson"), "feature").limit(k)
    neg = c.where(F.col("pearson") < 0).orderBy(F.asc("pearson"), "feature").limit(k)
    return pos.unionByName(neg)


def disagreement(corr: DataFrame, gap: float = 0.1) -> DataFrame:
    """Features whose Pearson and Spearman differ by more than ``gap``."""
    return corr.where(F.abs(F.col("pearson") - F.col("spearman")) > gap).select(
        "feature", "pearson", "spearman", F.abs(F.col("pearson") - F.col("spearman")).alias("gap"))


def importance_violations(importances: DataFrame, catalogue: DataFrame) -> DataFrame:
    """P23 (re-aimed to many models' importance rows): rows whose importance
    is NULL/NaN/negative, plus features unknown to the catalogue (left-anti
    join on ``feature``), each with its reason."""
    bad = importances.where(F.col("importance").isNull() | F.isnan("importance")
                            | (F.col("importance") < 0)).withColumn("reason", F.lit("invalid importance"))
    unknown = importances.join(catalogue.select("feature"), "feature", "left_anti").withColumn(
        "reason", F.lit("unknown feature"))
    return bad.unionByName(unknown)
