"""W3 without leaks: fits by run against pandas, and figures that a planted leak cannot raise."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import stats as S
from quire.operators import train as TR
from quire.operators.prepare import DataQualityError
from quire.plans import jobs as J
from quire.plans import leakfree as L

N = 420


def noise(spark, seed=5):
    """Features that say nothing about a rare class."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(N, 4)), columns=list("abcd"))
    pdf["ust"], pdf["user_id"] = (np.arange(N) % 7 == 0).astype(int), np.arange(N)
    return spark.createDataFrame(pdf)


def config(**kw):
    base = dict(n_estimators=[15], max_depth=[12], min_samples_split=[2], n_folds=3, n_bootstraps=30,
                oversampling_method="random", max_vif=5.0)
    return TR.ModelConfig(**(base | kw))


def test_fits_of_a_run_are_those_of_its_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.arange(90), "x": rng.normal(size=90), "z": rng.exponential(size=90) ** 2,
                        "fold": [None if i >= 75 else i % 3 for i in range(90)]})
    pdf.loc[80, "x"] = 1e6  # a test row: no run may see it
    pdf.loc[0, "x"] = 1e4   # of fold 0: its own run may not see it
    df = spark.createDataFrame([(int(a), float(b), float(c), None if pd.isna(d) else int(d)) for a, b, c, d in pdf.to_numpy()],
                               "k INT, x DOUBLE, z DOUBLE, fold INT")
    fits = L.fit_runs(df, ["x", "z"], [0, 1, 2, L.WHOLE])
    for r in (0, 1, 2, L.WHOLE):
        seen = pdf[pdf["fold"].notna() & (pdf["fold"] != r)]
        small = spark.createDataFrame(seen[["x", "z"]])
        prof = S.profile(small, ["x", "z"])
        scaler = S.fit_scaler(S.apply_outliers(small, prof, "median"), ["x", "z"])
        for c in ("x", "z"):
            assert fits[0][L._cell(c, r)] == pytest.approx(prof[c])
            assert fits[1][L._cell(c, r)] == pytest.approx(scaler[c])
        got = L.apply_run(df, ["x", "z"], r, fits, ["k", "fold"]).orderBy("k").toPandas()
        want = S.apply_scaler(S.apply_outliers(df, prof, "median"), scaler, 3).orderBy("k").toPandas()
        assert got["k"].tolist() == list(range(90))
        np.testing.assert_allclose(got[["x", "z"]].to_numpy(), want[["x", "z"]].to_numpy(), atol=1e-9)


def test_copies_made_before_the_folds_raise_only_the_leaky_figures(spark):
    df, cfg = noise(spark), config()
    leaky = J.train_and_evaluate(df, list("abcd"), cfg)["metrics"]
    res = L.train_leak_free(df, cfg, list("abcd"), None)
    free = res["metrics"]
    assert leaky["cv_roc_auc"] > 0.85 and leaky["cv_recall"] > 0.8
    assert free["cv_roc_auc"] < 0.65 and free["cv_recall"] < 0.4
    # every training row is judged once, as it came
    oof = res["out_of_fold"]
    assert oof.count() == oof.select("user_id").distinct().count() == N - int(np.ceil(0.2 * N))
    assert oof.where("user_id < 0").count() == 0
    assert set(res["folds"]) == {0, 1, 2} and res["scaler"]["a"] != res["folds"][0]["scaler"]["a"]


def test_a_real_signal_is_found_and_features_are_chosen_in_each_fold(spark):
    df = noise(spark).withColumn("ust", (F.col("a") + 0.4 * F.col("b") > 0.5).cast("int"))
    res = L.train_leak_free(df, config(max_depth=[3, 6], oversampling_method="smote"), list("abcd"), 1)
    assert res["metrics"]["cv_roc_auc"] > 0.8 and res["metrics"]["test_roc_auc"] > 0.8
    assert len(res["grid"]) == 4 and res["best_params"][1] == max(s for _, s in res["grid"])
    assert all("a" in f["features"] and len(f["features"]) <= 2 for f in res["folds"].values())


def test_one_class_is_refused(spark):
    with pytest.raises(DataQualityError):
        L.train_leak_free(noise(spark).withColumn("ust", F.lit(1)), config(), list("abcd"))
