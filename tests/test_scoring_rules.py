"""Rules of scoring, screening, selection and the registry on rows that trigger them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import registry as RG
from quire.operators import resample as R
from quire.operators.answers import validate_payload
from quire.operators.prepare import fit_categories, quality_report
from quire.operators.screen import screen
from quire.operators.stats import vif
from quire.plans.jobs import payload_features, preprocess
from quire.spec import FK_V1, FSK_V2

PAY = "array<struct<group:string,item:string,version:string,choiceNumber:int>>"


def payload(spec, change=None, drop=(), version="1"):
    rows = []
    for n, q in enumerate(spec.columns):
        if q not in drop:
            group, item = q.rstrip("0123456789"), q[len(q.rstrip("0123456789")):]
            rows.append((group, item, version, (change or {}).get(q, 1 + n % 3)))
    return rows


def reasons(spark, spec, rows, **kw):
    df = spark.createDataFrame(list(enumerate(rows)), f"resp_id int, answers {PAY}")
    return {r["resp_id"]: r for r in payload_features(df, spec, **kw).collect()}


def test_incomplete_payloads_are_rejected(spark):
    c = FK_V1.columns
    got = reasons(spark, FK_V1, [payload(FK_V1), payload(FK_V1, drop=(c[-1],)), payload(FK_V1, {c[0]: None}),
                                 payload(FK_V1, {c[3]: 9}), [], None])
    assert got[0]["reject_reason"] is None and got[0]["screening_passed"]
    assert all(got[i]["reject_reason"] for i in range(1, 6))


def test_dynamic_grouping_route(spark):
    late = payload(FK_V1, version="3")
    assert reasons(spark, FK_V1, [late])[0]["reject_reason"]
    assert reasons(spark, FK_V1, [late], grouping="dynamic")[0]["reject_reason"] is None
    with pytest.raises(ValueError):
        reasons(spark, FK_V1, [late], grouping="other")


def test_three_group_survey_screens_raw_answers(spark):
    got = reasons(spark, FSK_V2, [payload(FSK_V2), payload(FSK_V2, {c: 1 for c in FSK_V2.columns})])
    assert got[0]["screening_passed"] and got[1]["screening_msg"] == "All answers identical"


def test_null_choice_is_invalid(spark):
    df = spark.createDataFrame([(1, {"fht": [1, None]}), (2, {"fht": [1, 2]})], "i int, g map<string,array<int>>")
    got = {r["i"]: r["why"] for r in df.select("i", validate_payload(F.col("g"), ("fht",)).alias("why")).collect()}
    assert got == {1: "invalid values in fht", 2: None}


def test_text_answers_are_screened_out(spark):
    df = spark.createDataFrame([({"fht": ["1", "abc"]},), ({"fht": ["1", "2", "3"]},)], "g map<string,array<string>>")
    got = [r["s"]["screening_msg"] for r in df.select(screen(F.col("g"), ["fht"]).alias("s")).collect()]
    assert got[0] == "Non-integer values in fht" and got[1].startswith("1 (33%)")


def test_only_dependent_columns_are_collinear(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    rows = [(float(a), float(b), float(c), float(2 * a)) for a, b, c in x]
    for intercept in (True, False):
        got = {v["feature"]: v for v in vif(spark, spark.createDataFrame(rows, "a double, b double, c double, d double"),
                                            ["a", "b", "c", "d"], intercept).collect()}
        assert got["a"]["collinear"] and got["d"]["collinear"]
        assert 0.99 < got["b"]["vif"] < 1.1 and 0.99 < got["c"]["vif"] < 1.1
    pair = [(float(a), float(a + b)) for a, b, _ in x]
    rho = np.corrcoef(np.array(pair).T)[0, 1]
    got = vif(spark, spark.createDataFrame(pair, "a double, b double"), ["a", "b"]).collect()
    assert all(abs(v["vif"] - 1 / (1 - rho ** 2)) < 1e-6 for v in got)


def test_unknown_resampling_raises_and_levels_have_no_limit(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [2.0])], "id int, y int, v array<double>")
    with pytest.raises(ValueError):
        R.smote_family(df, "y", "id", "v", "smoth")
    many = spark.range(1500).select(F.col("id").cast("string").alias("c"))
    assert len(fit_categories(many, ["c"])["c"]) == 1500
    assert quality_report(many).where(~F.col("passed")).count() == 0


def test_outlier_removal_route(spark):
    rows = [(i, float(i % 7), float({5: 1000, 6: -1000}.get(i, i % 5)), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, ust int")
    out = preprocess(df, FK_V1, "remove")
    assert out.frame.where("user_id in (5, 6)").count() == 0 and out.frame.count() == 58


def test_registry_types_latest_and_artifacts(spark, tmp_dir):
    reg = RG.registry_row(spark, {"cv_f1": 0.5}, [("a", 1.0)], {"model_path": f"{tmp_dir}/m"}, "20250101_000000")
    RG.to_csv_view(reg).write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{tmp_dir}/csv")
    back = RG.read_csv_registry(spark, f"{tmp_dir}/csv")
    assert dict(back.dtypes)["max_vif"] == "double" and dict(back.dtypes)["n_folds"] == "int"
    assert RG.latest(reg.limit(0)).count() == 0
    spark.range(10).write.parquet(f"{tmp_dir}/m")
    man = RG.manifest(spark, f"{tmp_dir}/m")
    got = RG.resolve_artifacts(RG.latest(reg), man).first()
    assert got["model_path"] and len(got["model_checksum"]) == 64 and got["scaler_path"] == ""
    tampered = man.withColumn("sha256", F.sha2(F.lit("other").cast("binary"), 256))
    assert RG.resolve_artifacts(RG.latest(reg), tampered).first()["model_checksum"] != got["model_checksum"]


def test_exact_quantiles_after_narrowing(spark, monkeypatch):
    from quire.functions import quantiles as Q

    monkeypatch.setattr(Q, "HELD_ROWS", 50)
    r = np.random.default_rng(0)
    x, t = r.normal(size=5000) ** 3, r.integers(0, 4, 5000).astype(float)
    rows = [(float(a), float(b), None if i % 2 else float(a)) for i, (a, b) in enumerate(zip(x, t))] + [(float("nan"), 1.0, None)]
    df = spark.createDataFrame(rows, "a double, t double, h double").repartition(5)
    got = Q.exact_quantiles(df, ["a", "t", "h"], (0.0, 0.25, 0.5, 0.9, 1.0))
    t = np.append(t, 1.0)
    for c, v in (("a", x), ("t", t), ("h", x[::2])):
        assert np.allclose(got[c], np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]), atol=1e-9)
    assert Q.exact_quantiles(df.limit(0), ["a"], (0.5,)) == {"a": [None]}
