"""W4 chains on rows with a known signal, T7's figures against a plain version."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import resample as R
from quire.operators import train as TR
from quire.operators.prepare import DataQualityError
from quire.plans import trainers as W4
from quire.sources import fixtures as FX
from tests.conftest import SF_SMALL

FEATS = list("abcd")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=400) * 0.4 > 0.5).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=FEATS).assign(ust=y, user_id=np.arange(400))).cache()


def plain_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_cross_validated_figures_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"fold": np.arange(90) % 3, "ust": rng.integers(0, 2, 90), "p1": rng.integers(0, 10, 90) / 10})
    got = W4.cross_validated(spark.createDataFrame(pdf), "ust", 3)
    pred, y = (pdf.p1 >= 0.5).astype(int), pdf.ust
    assert got["cv_accuracy"] == pytest.approx((pred == y).mean())
    assert got["cv_precision"] == pytest.approx((pred & y).sum() / pred.sum())
    assert got["cv_recall"] == pytest.approx((pred & y).sum() / y.sum())
    assert got["cv_roc_auc"] == pytest.approx(plain_auc(y.to_numpy(), pdf.p1.to_numpy()))
    each = [plain_auc(g.ust.to_numpy(), g.p1.to_numpy()) for _, g in pdf.groupby("fold")]
    assert got["cv_scores"] == pytest.approx(each)
    assert got["cv_score_mean"] == pytest.approx(np.mean(each)) and got["cv_score_std"] == pytest.approx(np.std(each))


def test_logistic_chain(rows):
    res = W4.logistic_chain(rows, FEATS)
    assert {"a", "b"} <= set(res.features) and res.importances[0][0] == "a"
    m = res.metrics
    assert m["test_roc_auc"] == pytest.approx(m["elimination_roc_auc"]) and m["cv_roc_auc"] > 0.9
    assert len(m["cv_scores"]) == 5 and min(m["cv_scores"]) > 0.8
    assert sum(r["support"] for r in res.report.collect()) == 80
    # one fold by hand
    data = TR.with_class_weight(rows, "ust", "balanced", "w")
    data = TR.assemble(R.stratified_folds(data, "ust", "user_id", 5, 42), res.features)
    part = data.where("fold <> 2")
    fit = TR.logistic("ust", "w", n_rows=part.count()).fit(part)
    out = TR.probability_of_one(fit.transform(data.where("fold = 2"))).select("ust", "p1").toPandas()
    assert m["cv_scores"][2] == pytest.approx(plain_auc(out.ust.to_numpy(), out.p1.to_numpy()))


def test_forest_chain(rows):
    cfg = TR.ModelConfig(n_estimators=[5, 8], max_depth=[3], min_samples_split=[2], n_folds=3, n_bootstraps=50,
                         oversampling_method="random", scoring="roc_auc", n_features_to_select=1)
    res = W4.forest_chain(rows, FEATS, cfg)
    assert len(res.features) == 2 and "a" in res.features  # max(1, 4 // 2)
    m = res.metrics
    assert m["test_roc_auc"] > 0.8 and len(m["cv_scores"]) == 3
    assert m["accuracy_ci_lower"] <= m["test_accuracy"] <= m["accuracy_ci_upper"] and "pr_auc_ci_lower" not in m


def test_legacy_chain_reads_the_cohort(spark):
    users = FX.legacy_users(spark, SF_SMALL)
    res = W4.legacy_chain(users, "user_id", n_trees=10, n_folds=3)
    assert res.features == [f"set{i}" for i in range(1, 12)]
    assert sum(v for _, v in res.importances) == pytest.approx(1.0)
    assert {f for f, _ in res.importances[:4]} & {"set1", "set2"}
    assert len(res.metrics["cv_scores"]) == 3 and 0 <= res.metrics["test_accuracy"] <= 1


def test_one_class_and_no_feature_are_refused(rows):
    one = rows.where("ust = 1")
    for run in (lambda: W4.logistic_chain(one, FEATS), lambda: W4.forest_chain(one, FEATS, TR.ModelConfig()),
                lambda: W4.logistic_chain(rows, [])):
        with pytest.raises(DataQualityError):
            run()


def test_figures_table_numbers_lists(spark):
    got = {r["metric"]: r["value"] for r in W4.figures_table(spark, {"a": 1, "s": [0.5, None]}).collect()}
    assert got == {"a": 1.0, "s_0": 0.5, "s_1": None}
    assert W4.figures_table(spark, {}).select(F.count(F.lit(1))).first()[0] == 0
