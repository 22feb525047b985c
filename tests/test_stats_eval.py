"""Statistics, selection, evaluation: cross-checks against numpy/pandas
brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate as E
from quire.operators import select as T
from quire.operators import stats as S
from quire.functions.exprs import round_half_even
from quire.operators.features import engineer
from quire.operators.screen import approval, screen
from quire.spec import FK_V1

RNG = np.random.default_rng(7)


def _frame(spark, n=300, p=4):
    x = RNG.normal(size=(n, p))
    x[:, 2] = x[:, 0] * 0.8 + RNG.normal(scale=0.3, size=n)
    x[:, 3] = np.round(np.abs(x[:, 3]) ** 3, 2)          # skewed
    y = (x[:, 0] + RNG.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(p)])
    pdf["y"] = y
    pdf["id"] = np.arange(n)
    return spark.createDataFrame(pdf), pdf


def test_profile_matches_numpy(spark):
    df, pdf = _frame(spark)
    prof = S.profile(df, ["x0", "x3"])
    for c in ("x0", "x3"):
        v = pdf[c].to_numpy()
        m = v.mean()
        g1 = ((v - m) ** 3).mean() / ((v - m) ** 2).mean() ** 1.5
        assert prof[c]["skewness"] == pytest.approx(g1, rel=1e-9)
        assert prof[c]["q1"] == pytest.approx(np.percentile(v, 25))
        assert prof[c]["q3"] == pytest.approx(np.percentile(v, 75))
        assert prof[c]["var_samp"] == pytest.approx(v.var(ddof=1))


def test_outlier_rules_match_pandas(spark):
    df, pdf = _frame(spark)
    cols = ["x0", "x1", "x3"]
    prof = S.profile(df, cols)
    got = S.apply_outliers(df, prof, "cap").toPandas().sort_values("id")
    for c in cols:
        v = pdf[c]
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        m = ((v - v.mean()) ** 3).mean() / ((v - v.mean()) ** 2).mean() ** 1.5
        exp = v.where(~((v < lo) | (v > hi)), v.median()) if abs(m) > 1 else v.clip(lo, hi)
        np.testing.assert_allclose(got[c].to_numpy(), exp.to_numpy())
    # remove: sequential, refitted per column
    rem = S.remove_outliers(df, cols, checkpoint_every=2).toPandas()
    cur = pdf.copy()
    for c in cols:
        v = cur[c]
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        sk = ((v - v.mean()) ** 3).mean() / ((v - v.mean()) ** 2).mean() ** 1.5
        mask = (v < lo) | (v > hi)
        if abs(sk) > 1:
            cur.loc[mask, c] = v.median()
        else:
            cur = cur[~mask]
    assert len(rem) == len(cur)


def test_scaler_and_rounding(spark):
    df, pdf = _frame(spark)
    params = S.fit_scaler(df, ["x0", "x1"])
    out = S.apply_scaler(df, params).toPandas()
    assert out["x0"].mean() == pytest.approx(0, abs=1e-12)
    assert out["x0"].std(ddof=0) == pytest.approx(1, rel=1e-12)
    r = spark.createDataFrame([(0.0005,), (0.0015,), (-0.0025,), (1.2345,)], "v double")
    vals = [x[0] for x in r.select(round_half_even(F.col("v"), 3)).collect()]
    assert vals == [float(np.round(v, 3)) for v in (0.0005, 0.0015, -0.0025, 1.2345)]


def test_correlations_match_pandas(spark):
    df, pdf = _frame(spark)
    pdf["c"] = 1.0
    df = df.withColumn("c", F.lit(1.0))
    ints = pdf.copy()
    ints["x3"] = np.round(ints["x3"])
    dfi = spark.createDataFrame(ints)
    for frame, p, part_rows in ((df, pdf, 10 ** 6), (dfi, ints, 10 ** 6), (df, pdf, 60)):
        got = {r["feature"]: r for r in S.correlation_table(frame, ["x0", "x3", "c"], "y", part_rows).collect()}
        for c in ("x0", "x3"):
            assert got[c]["pearson"] == pytest.approx(p[c].corr(p["y"]), rel=1e-9)
            rho = p[c].rank().corr(p["y"].rank())  # Spearman = Pearson of average ranks
            assert got[c]["spearman"] == pytest.approx(rho, rel=1e-9)
        assert got["c"]["pearson"] is None and got["c"]["spearman"] is None


def _vif_bruteforce(x, intercept):
    out = []
    for i in range(x.shape[1]):
        yv = x[:, i]
        others = np.delete(x, i, axis=1)
        if intercept:
            others = np.column_stack([others, np.ones(len(yv))])
        beta, *_ = np.linalg.lstsq(others, yv, rcond=None)
        resid = yv - others @ beta
        tss = ((yv - yv.mean()) ** 2).sum() if intercept else (yv ** 2).sum()
        out.append(1.0 / (resid @ resid / tss))
    return out


def test_vif_matches_regression(spark):
    df, pdf = _frame(spark)
    cols = ["x0", "x1", "x2", "x3"]
    x = pdf[cols].to_numpy()
    for intercept in (True, False):
        got = {r["feature"]: r["vif"] for r in S.vif(spark, df, cols, intercept).collect()}
        exp = _vif_bruteforce(x, intercept)
        for c, e in zip(cols, exp):
            assert got[c] == pytest.approx(e, rel=1e-6)
    dup = df.withColumn("x4", F.col("x0") * 2)
    rows = {r["feature"]: r for r in S.vif(spark, dup, cols + ["x4"]).collect()}
    assert rows["x4"]["collinear"] and rows["x4"]["vif"] is None


def test_selection_and_chart(spark):
    corr = spark.createDataFrame(
        [("a", 0.5, 0.45), ("b", -0.2, -0.3), ("c", 0.1, 0.3), ("d", -0.6, -0.5), ("e", None, None)],
        "feature string, pearson double, spearman double")
    top = [r["feature"] for r in T.top_by(corr, "spearman", 1).orderBy("position").collect()]
    assert top == ["a", "d"]
    assert [r["feature"] for r in T.disagreement(corr).collect()] == ["c"]
    chart = [r["feature"] for r in T.chart_data(corr, 10).collect()]
    assert set(chart) == {"a", "c", "b", "d"}


def test_filter_correlated_greedy(spark):
    df, pdf = _frame(spark)
    kept = T.filter_correlated(spark, df, ["x0", "x1", "x2"], 0.7)
    # x0 and x2 are highly correlated; the lower-variance one is dropped
    drop = "x2" if pdf["x0"].var() > pdf["x2"].var() else "x0"
    assert drop not in kept and len(kept) == 2


def _sk_pr_auc(y, s):
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    thr_idx = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps = np.cumsum(y)[thr_idx]
    fps = (1 + thr_idx) - tps
    prec = tps / (tps + fps)
    rec = tps / tps[-1]
    prec, rec = np.r_[prec[::-1], 1], np.r_[rec[::-1], 0]
    return -np.trapezoid(prec, rec) if hasattr(np, "trapezoid") else -np.trapz(prec, rec)


def test_curves_match_bruteforce(spark):
    y = RNG.integers(0, 2, 400)
    s = np.round(RNG.random(400) + y * 0.3, 1)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    cells = E.score_cells(df)
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert E.roc_auc(cells).first()["roc_auc"] == pytest.approx(auc, rel=1e-12)
    assert E.roc_auc(cells, part_rows=3).first()["roc_auc"] == pytest.approx(auc, rel=1e-12)
    for part_rows in (10 ** 6, 3):
        assert E.pr_auc(cells, part_rows=part_rows).first()["pr_auc"] == pytest.approx(_sk_pr_auc(y, s), rel=1e-12)


def test_count_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, pred int")
    r = E.count_metrics(df, zero_division=1.0).first()
    assert r["precision"] == 1.0 and r["recall"] == 0.0 and r["accuracy"] == pytest.approx(2 / 3)
    r0 = E.count_metrics(df, zero_division=0.0).first()
    assert r0["precision"] == 0.0
    rep = {r["class"]: r for r in E.per_class_report(df).collect()}
    assert rep[0]["recall"] == 1.0 and rep[1]["support"] == 1


def test_bootstrap_deterministic_and_bounded(spark):
    y = RNG.integers(0, 2, 200)
    s = RNG.random(200)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s, "pred": (s >= 0.5).astype(int)}))
    a = E.bootstrap_ci(df, n_boot=50).first().asDict()
    b = E.bootstrap_ci(df, n_boot=50).first().asDict()
    assert a == b
    for k, v in a.items():
        if k != "valid":
            assert 0.0 <= v <= 1.0
    assert a["roc_auc_ci_lower"] <= a["roc_auc_ci_upper"]
    tiny = spark.createDataFrame([(1, 0.9, 1)] * 5, "label int, score double, pred int")
    assert E.bootstrap_ci(tiny, n_boot=20).first()["f1_ci_upper"] == 0.0


def _draws(m, n, key=5, seed=1):
    return E.poisson_counts(m, key, seed, n)


@pytest.mark.parametrize("m", [1, 2, 9, 10, 33, 1000, 10 ** 6])
def test_draws_have_the_law_at_every_cell_size(m):
    x, n = _draws(m, 400_000), 400_000
    assert abs(x.mean() - m) < 5 * (m / n) ** 0.5
    assert abs(x.var() / m - 1) < 5 * ((2 + 1 / m) / n) ** 0.5
    assert abs((((x - x.mean()) / x.std()) ** 3).mean() - m ** -0.5) < 0.03
    if m < 40:  # the whole distribution
        p = np.exp(-m)
        for k in range(60):
            assert abs((x == k).mean() - p) < 5 * (p / n) ** 0.5 + 1e-9
            p *= m / (k + 1)


def test_draw_time_does_not_grow_with_the_cell():
    import time
    took = {}
    for m in (50, 10 ** 9):
        t = time.perf_counter()
        for k in range(50):
            _draws(m, 1000, key=k)
        took[m] = time.perf_counter() - t
    assert took[10 ** 9] < 3 * took[50] + 0.05


def test_replicates_equal_plain_weighted_metrics(spark):
    """Every replicate against metrics of rows repeated as often as their cell was drawn."""
    rng, n_boot = np.random.default_rng(8), 40
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s, "pred": (s >= 0.6).astype(int)}))
    cells = df.groupBy("score", "label", "pred").count().withColumn("key", F.xxhash64("score", F.col("label").cast("int"), F.col("pred").cast("int"))).collect()
    w = {(c["score"], c["label"], c["pred"]): E.poisson_counts(c["count"], c["key"], 42, n_boot) for c in cells}
    want = {m: [] for m in ("precision", "recall", "f1", "roc_auc", "pr_auc", "accuracy")}
    for b in range(n_boot):
        rows = [(k, int(v[b])) for k, v in w.items() for _ in [0]]
        ys = np.concatenate([[k[1]] * c for k, c in rows]).astype(int)
        ss = np.concatenate([[k[0]] * c for k, c in rows])
        ps = np.concatenate([[k[2]] * c for k, c in rows]).astype(int)
        tp, fp, fn = ((ys == 1) & (ps == 1)).sum(), ((ys == 0) & (ps == 1)).sum(), ((ys == 1) & (ps == 0)).sum()
        pos, neg = ss[ys == 1], ss[ys == 0]
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        for m, v in (("precision", tp / (tp + fp)), ("recall", tp / (tp + fn)), ("f1", 2 * tp / (2 * tp + fp + fn)), ("roc_auc", auc),
                     ("pr_auc", _sk_pr_auc(ys, ss)), ("accuracy", (ys == ps).mean())):
            want[m].append(v)
    for part_rows in (10 ** 6, 20):
        got = E.bootstrap_ci(df, n_boot=n_boot, alpha=0.1, with_accuracy=True, part_rows=part_rows).first().asDict()
        assert got.pop("valid") == n_boot
        for m, v in want.items():
            assert got[f"{m}_ci_lower"] == pytest.approx(np.percentile(v, 5), rel=1e-9)
            assert got[f"{m}_ci_upper"] == pytest.approx(np.percentile(v, 95), rel=1e-9)
    assert "pr_auc_ci_lower" not in E.bootstrap_ci(df, n_boot=10, with_pr_auc=False).columns


def _screen(spark, groups):
    df = spark.createDataFrame([(groups,)], "g map<string,array<double>>")
    return df.select(screen(F.col("g"), ["fht", "kmsi"]).alias("s")).first()["s"]


def test_screening_rules(spark):
    assert _screen(spark, {"fht": [1.0, 2.0], "kmsi": [3.0, 4.0]})["screening_msg"] == \
        "Values in kmsi must be between 1 and 3"
    assert _screen(spark, {"fht": [2.0, 2.0], "kmsi": [2.0]})["screening_msg"] == "All answers identical"
    r = _screen(spark, {"fht": [3.0] * 8, "kmsi": [3.0] * 7 + [2.0]})
    z = (sum([3] * 15 + [2]) / 16 - 2) / (math.sqrt(2 / 3) / 4)
    assert not r["screening_passed"] and r["screening_msg"] == f"Anomalous score detected (z={z:.2f})"
    ok = _screen(spark, {"fht": [1.0, 2.0, 3.0], "kmsi": [2.0, 2.0, 1.0]})
    assert ok["screening_passed"] and ok["screening_msg"] == "1 (33%), 2 (50%), 3 (16%)"
    assert _screen(spark, {"fht": [], "kmsi": [1.0]})["screening_msg"] == "Invalid or empty list for fht"
    df = spark.createDataFrame([(True, 0), (True, 1), (False, 0)], "p boolean, m int")
    assert [r[0] for r in df.select(approval(F.col("p"), F.col("m"))).collect()] == \
        ["approved", "rejected", "rejected"]


def test_group_features_match_pandas(spark):
    x = RNG.integers(1, 4, size=(50, 16)).astype(float)
    pdf = pd.DataFrame(x, columns=FK_V1.columns)
    out = engineer(spark.createDataFrame(pdf), FK_V1).toPandas()
    for g, cols in FK_V1.groups.items():
        np.testing.assert_allclose(out[f"{g}_score_sum"], pdf[cols].sum(axis=1))
        np.testing.assert_allclose(out[f"{g}_score_var"], pdf[cols].var(axis=1).fillna(0))
        np.testing.assert_allclose(out[f"{g}_high_score_count"], (pdf[cols] == 3).sum(axis=1))
    np.testing.assert_allclose(out["loan_to_saving_ratio"],
                               pdf[["kmsi1", "kmsi2"]].sum(axis=1) / (pdf[["fht3", "fht4"]].sum(axis=1) + 1))
