"""URL filter: rules first, then empirical-Bayes host reputation (operator 1).

Labelled page outcomes are counted per host, registered domain and public
suffix.  Each level is a beta-binomial: the suffix is shrunk towards the whole
table, the registered domain towards its suffix, the host towards its domain.
How strongly comes from the spread between the groups of a level (moment
estimate of the beta-binomial's intra-class correlation).  A host is blocked
when the lower posterior bound of its bad rate reaches ``max_bad_rate``.

Only DataFrame functions are used.  Three numbers per level (precisions) and
the overall rate come to the driver.  The host table joins the pages on
``host``; a host with a third of the pages is an ordinary skewed join.

Defined cases: a null url, or one without ``://``, has empty host and path; the
empty host is a host like any other.  Null outcomes are ignored, repeated rows
are judged each, and with no outcomes at all every prior is one half and
nothing is blocked.  Columns of the outcome table other than its key and value
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_url_parts(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` of ``url``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract("__rest", r"^[^/?#]*", 0)
    return (pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
            .withColumn("__raw", raw)
            .withColumn("host", F.translate("__raw", UPPER, LOWER))
            .withColumn("path", F.regexp_extract(F.expr("substring(__rest, length(__raw) + 1)"), r"^[^?#]*", 0))
            .drop("__rest", "__raw"))


def with_domains(df: DataFrame) -> DataFrame:
    """Add ``domain`` (the last two labels of ``host``, port aside) and ``suffix`` (the last)."""
    parts = F.split(F.regexp_replace("host", r":[0-9]*$", ""), r"\.")
    return (df.withColumn("__p", parts)
            .withColumn("suffix", F.element_at("__p", -1))
            .withColumn("domain", F.expr("array_join(slice(__p, greatest(size(__p) - 1, 1), 2), '.')"))
            .drop("__p"))


def matching_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) columns of the longest fitting rule; null where none fits.

    ``rules`` are (``allow``/``block``, ``host/path``).  They form one CASE
    expression, so they are meant to be a list kept by hand.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host))
                & F.col("path").startswith("/" + path))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def precision(groups: DataFrame, least: float, most: float) -> float:
    """Prior precision (pseudo-counts) of a level from its groups' ``n`` and ``bad``."""
    t = groups.select(
        F.sum("n").alias("n"), F.sum("bad").alias("b"), F.count(F.lit(1)).alias("g"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb")).first()
    if not t["n"]:
        return most
    n, p, g = float(t["n"]), t["b"] / t["n"], t["g"]
    within = p * (1 - p)
    room = within * (n - t["nn"] / n - (g - 1))
    between = (t["bb"] - n * p * p) - within * (g - 1)
    if room <= 0 or between <= 0:
        return most
    return min(most, max(least, room / between - 1))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, *, z: float = 1.645, max_bad_rate: float = 0.2,
                    least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """Posterior of the bad rate for each distinct host.

    ``hosts(host)`` may repeat; ``outcomes(host, bad)`` has one labelled page
    per row (``bad`` 0, 1 or null).  Returns ``host, bad_mean, bad_low, blocked``.
    """
    seen = (outcomes.where("bad is not null").groupBy("host")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")))
    per_host = with_domains(hosts.select("host").distinct().join(seen, "host", "left").na.fill(0, ["n", "bad"]))
    per_domain = per_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    k_host, k_domain, k_suffix = (precision(x.where("n > 0"), least, most) for x in (per_host, per_domain, per_suffix))
    total = per_suffix.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)
    shrunk = lambda k, prior: (F.col("bad") + k * prior) / (F.col("n") + k)
    suffix = per_suffix.select("suffix", shrunk(k_suffix, F.lit(overall)).alias("suffix_rate"))
    domain = per_domain.join(suffix, "suffix").select("domain", shrunk(k_domain, F.col("suffix_rate")).alias("domain_rate"))
    a, size = F.col("bad") + k_host * F.col("domain_rate"), F.col("n") + F.lit(k_host)
    mean = a / size
    low = mean - z * F.sqrt(mean * (1 - mean) / (size + 1))
    return (per_host.join(domain, "domain")
            .select("host", mean.alias("bad_mean"), low.alias("bad_low"), (low >= max_bad_rate).alias("blocked")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], **method) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` are the labelled pages.  The longest fitting
    rule decides; where none fits, the host's reputation does.
    """
    parts = with_url_parts(pages.select("page_id", "url")).drop("url")
    labelled = (parts.select("page_id", "host")
                .join(outcomes.select("page_id", F.col("bad").cast("long").alias("bad")), "page_id")
                .select("host", "bad"))
    hosts = host_reputation(parts.select("host"), labelled, **method)
    rule, verdict = matching_rule(rules)
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return (parts.join(hosts, "host").withColumn("rule", rule)
            .select("page_id", "host", "path", "rule", F.coalesce(verdict, by_host).alias("verdict")))
