"""Grid search and the training job with fold counts other than MLlib's default."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import resample as R
from quire.operators import train as TR
from quire.plans import jobs as J


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=260) * 0.3 > 0.4).astype(int)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(ust=y, user_id=np.arange(260))
    return spark.createDataFrame(pdf).cache()


def small(n_folds, **kw):
    return TR.ModelConfig(n_estimators=[5, 8], max_depth=[2, 3], min_samples_split=[2], n_folds=n_folds, n_bootstraps=30, **kw)


@pytest.mark.parametrize("n_folds", [2, 5])
def test_grid_search_uses_the_folds_it_is_given(rows, n_folds):
    cfg = small(n_folds)
    folds = R.stratified_folds(rows, "ust", "user_id", n_folds, 42)
    best, grid = TR.grid_search(folds, list("abcd"), "ust", cfg)
    assert len(grid) == 2 * 2 * 2 and best in grid and best[1] == max(s for _, s in grid) > 0.7
    # one point by hand: the mean over the folds of the score on the fold left out
    p, score = next(g for g in grid if g[0]["weight"] == "w_bal")
    data = TR.assemble(TR.with_class_weight(folds, "ust", "balanced", "w_bal"), list("abcd"))
    each = []
    for f in range(n_folds):
        m = TR.forest("ust", p["numTrees"], p["maxDepth"], weight="w_bal", seed=42).fit(data.where(F.col("fold") != f))
        each.append(TR.scorer("f1", "ust").evaluate(m.transform(data.where(F.col("fold") == f))))
    assert score == pytest.approx(np.mean(each), abs=0.05)


@pytest.mark.parametrize("n_folds", [2, 4])
def test_train_and_evaluate_runs_with_other_fold_counts(rows, n_folds):
    m = J.train_and_evaluate(rows, list("abcd"), small(n_folds))["metrics"]
    assert m["test_roc_auc"] > 0.8 and 0 <= m["cv_score_mean"] <= 1
