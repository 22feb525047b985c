"""The Gram pass against numpy: many columns, missing values, large means, few and many tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import stats as S


def frame(spark, x, parts):
    return spark.createDataFrame(pd.DataFrame(x, columns=[f"x{i}" for i in range(x.shape[1])])).repartition(parts)


def test_three_hundred_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 300)) + rng.normal(size=(700, 1))
    g = S.gram(frame(spark, x, 5), [f"x{i}" for i in range(300)])
    assert g["n"] == 700
    np.testing.assert_allclose(g["mean"], x.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(g["cov"], np.cov(x, rowvar=False), atol=1e-11)
    np.testing.assert_allclose(g["raw"], x.T @ x, rtol=1e-10, atol=1e-8)
    np.testing.assert_allclose(S.corr_from_gram(g), np.corrcoef(x, rowvar=False), atol=1e-11)


@pytest.mark.parametrize("fan", [2, 256])
def test_large_means_lose_no_digits_however_tasks_are_merged(spark, monkeypatch, fan):
    monkeypatch.setattr(S, "MERGE_FAN", fan)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) + [1e8, -1e8, 0]
    x[:, 2] += x[:, 0] - 1e8
    # the last rows far from the first: the means of tasks differ
    x[250:] += 1e4
    df = frame(spark, x, 1).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(9, "at")
    g = S.gram(df, ["x0", "x1", "x2"])
    np.testing.assert_allclose(g["cov"], np.cov(x - [1e8, -1e8, 0], rowvar=False), rtol=1e-9)


def test_nulls_leave_their_pairs_only(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(400, 4)) + 5, columns=list("abcd"))
    pdf["d"] += pdf["a"]
    rows = [[None if (i * 7 + j) % 5 == 0 and j < 3 else float(v) for j, v in enumerate(r)]
            for i, r in enumerate(pdf.to_numpy())]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE").repartition(6)
    held = pd.DataFrame([[np.nan if v is None else v for v in r] for r in rows], columns=list("abcd"))
    g = S.gram(df, list("abcd"))
    np.testing.assert_allclose(g["cov"], held.cov().to_numpy(), atol=1e-12)
    np.testing.assert_allclose(g["mean"], held.mean().to_numpy(), atol=1e-12)
    both = held.fillna(0.0).to_numpy()
    np.testing.assert_allclose(g["raw"], both.T @ both, rtol=1e-12)


def test_empty_null_constant_and_nan_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, 1.0), (2.0, None, 2.0, float("nan")), (4.0, None, 2.0, 3.0)],
                               "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    g = S.gram(df, list("abcd"))
    r = S.corr_from_gram(g)
    assert r[0, 0] == pytest.approx(1) and np.isnan(r[1]).all() and np.isnan(r[2]).all() and np.isnan(r[3]).all()
    assert [(f, v, c) for f, v, c in S.vif_from_gram(g, ["a", "c"])] == [("a", 1.0, False), ("c", None, True)]
    empty = S.gram(df.where("false"), list("abcd"))
    assert empty["n"] == 0 and np.isnan(empty["cov"]).all() and np.isnan(empty["mean"]).all()
    assert S.pearson_matrix(spark, df.where("false"), ["a", "c"]).where("r is not null").count() == 0
