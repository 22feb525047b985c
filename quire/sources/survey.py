"""Survey sources: labelled training load (S1/S2), legacy cohort (S3),
pending customers (S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def target_expr(status: str = "loan_status"):
    """Npl -> 1, healthy -> 0, anything else NULL."""
    s = F.col(status)
    return F.when(s == "npl", 1).when(s == "healthy", 0)


def status_eligible():
    """P2, status part: (npl and payoff < 0) or (healthy and payoff >= 5)."""
    s, p = F.col("loan_status"), F.col("payoff_score")
    return ((s == "npl") & (p < 0)) | ((s == "healthy") & (p >= 5))


def labelled_load(users: DataFrame, answers: DataFrame, features: DataFrame,
                  statuses: DataFrame, slug: str, distinct_status: bool = False, parse=None) -> DataFrame:
    """S1 (+P1, P2): users LEFT JOIN answers LEFT JOIN features LEFT JOIN
    statuses, WHERE slug and answer are not NULL, the status is eligible and
    the slug is the survey version.  Every predicate rejects NULL right
    sides, so this equals three inner joins, written as such with each
    predicate on the side it reads.  One row per matching (user, answer, status): a user
    with k eligible statuses appears k times.

    ``distinct_status`` collapses statuses to distinct (user, target) before
    the join.  Consumers that de-duplicate afterwards (the feature job) get
    the same result, and a user holding a third of all statuses then costs
    one row per map task (partial aggregation) instead of a skewed join.

    ``parse`` turns the survey version's answers (P3-P5: a row for a row, ``answer`` replaced by
    its columns) before they meet users and statuses, so the joins move a few integers and not the arrays,
    and an answer is parsed once however many statuses its user has.
    """
    st = statuses.where(status_eligible()).select("user_id", target_expr().alias("ust"))
    if distinct_status:
        st = st.distinct()
    a = answers.select("user_id", "feature_id", "answer").where(F.col("answer").isNotNull())
    # answers of this survey version first, so that only they meet the users;
    # whether the catalogue is broadcast is left to Spark's byte threshold
    f = features.where(F.col("feature_slug").isNotNull() & (F.col("feature_slug") == slug))
    chosen = a.join(f.select("feature_id", "feature_slug"), "feature_id")
    if parse is not None:
        chosen = parse(chosen.select("user_id", "feature_id", "answer"))
    out = [c for c in chosen.columns if c not in ("user_id", "feature_id", "feature_slug")]
    return (chosen.join(users.select("user_id"), "user_id").join(st.where("ust is not null"), "user_id")
            .select("user_id", "feature_id", *out, "ust"))


def legacy_cohort(users: DataFrame, n_items: int = 11, key: str | None = None) -> DataFrame:
    """S3: ``set_i -> seti`` and keep settled users or recovered payers:
    ``user_status = 1 OR (user_status = 0 AND payoff_score > 4)``.  ``key`` names an id to carry along."""
    cols = [F.col(f"set_{i}").alias(f"set{i}") for i in range(1, n_items + 1)]
    keep = (F.col("user_status") == 1) | ((F.col("user_status") == 0) & (F.col("payoff_score") > 4))
    return users.where(keep).select(*([key] if key else []), *cols, "init_payoff_score", "user_status", "payoff_score")


def pending_customers(new_customers: DataFrame) -> DataFrame:
    """Rows not processed yet."""
    return new_customers.where(F.col("processed") == 0)
