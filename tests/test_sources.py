"""S3/S4 legacy sources and the labelled load's join semantics."""

from pyspark.sql import functions as F

from quire.sources.survey import labelled_load, legacy_cohort, pending_customers


def test_legacy_cohort_and_pending(spark):
    cols = ", ".join(f"set_{i} int" for i in range(1, 12))
    rows = [tuple(range(1, 12)) + (1, 1, 0.0), tuple(range(1, 12)) + (1, 0, 5.0),
            tuple(range(1, 12)) + (1, 0, 4.0), tuple(range(1, 12)) + (1, 2, 9.0)]
    df = spark.createDataFrame(rows, f"{cols}, init_payoff_score int, user_status int, payoff_score double")
    out = legacy_cohort(df)
    assert out.count() == 2 and "set3" in out.columns and "set_3" not in out.columns
    nc = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "customer_id long, processed int")
    assert sorted(r[0] for r in pending_customers(nc).select("customer_id").collect()) == [1, 3]


def test_labelled_load_multiplicity(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    item = "array<struct<group:string,questionNumber:string,choiceNumber:string>>"
    answers = spark.createDataFrame([(1, 1, [("fht", "1", "1")]), (2, 1, [("fht", "1", "2")]),
                                     (3, 0, [("fht", "1", "3")])], f"user_id long, feature_id int, answer {item}")
    feats = spark.createDataFrame([(0, "fsk_v1.0"), (1, "fsk_v2.0")], "feature_id int, feature_slug string")
    st = spark.createDataFrame([(1, "npl", -1), (1, "npl", -2), (2, "healthy", 4), (2, "healthy", 7),
                                (3, "npl", -1)], "user_id long, loan_status string, payoff_score int")
    out = labelled_load(users, answers, feats, st, "fsk_v2.0")
    got = sorted((r["user_id"], r["ust"]) for r in out.collect())
    assert got == [(1, 1), (1, 1), (2, 0)]
    d = labelled_load(users, answers, feats, st, "fsk_v2.0", distinct_status=True)
    assert sorted((r["user_id"], r["ust"]) for r in d.collect()) == [(1, 1), (2, 0)]
