"""W1 and W2 stop at the step whose frame fails; P18's dictionary."""

import pytest
from pyspark.sql import functions as F

from quire.operators import prepare as PR
from quire.operators.prepare import DataQualityError
from quire.plans import jobs as J
from quire.spec import FK_V1
from tests.conftest import SF_SMALL


def test_an_empty_load_stops_the_chain(spark):
    with pytest.raises(DataQualityError, match="raw.non_empty"):
        J.feature_run(spark, SF_SMALL, slug="no_such_survey")


@pytest.mark.parametrize("step,frame", [("clean", "cleaned"), ("transform", "transformed")])
def test_a_step_that_loses_all_rows_stops_the_chain(spark, monkeypatch, step, frame):
    real = getattr(J, step)
    monkeypatch.setattr(J, step, lambda *a, **k: real(*a, **k).where("false"))
    monkeypatch.setattr(J, "engineer", lambda *a: pytest.fail("a later step ran"))
    with pytest.raises(DataQualityError, match=f"{frame}.non_empty"):
        J.feature_run(spark, SF_SMALL)


def test_a_missing_engineered_column_stops_the_chain(spark, monkeypatch):
    real, lost = J.engineer, [c for c in FK_V1.engineered_columns() if c not in FK_V1.columns][0]
    monkeypatch.setattr(J, "engineer", lambda *a: real(*a).drop(lost))
    with pytest.raises(DataQualityError, match="engineered.required_features"):
        J.feature_run(spark, SF_SMALL)


def test_a_sound_run_keeps_its_reports(spark):
    run = J.feature_run(spark, SF_SMALL)
    frames = [r["frame"] for rep in run.reports for r in rep.select("frame").distinct().collect()]
    assert frames == ["raw", "cleaned", "transformed", "engineered"]
    assert all(r["passed"] for rep in run.reports for r in rep.collect())


def test_no_selected_feature_stops_w2(spark):
    rows = spark.createDataFrame([(i, float(i % 2), float(i // 2 % 2), i % 2) for i in range(8)], "user_id long, x double, y double, ust int")
    flat = rows.withColumn("x", F.col("y"))  # y is independent of the target
    with pytest.raises(DataQualityError, match="no feature"):
        J.preprocess_and_select(flat, FK_V1)


def test_warned_rules_are_reported_only(spark):
    df = spark.createDataFrame([(1, 1)], "x int, ust int")
    rep = PR.enforce(df, "f", warn=("target_two_classes",), target="ust")
    assert [r["check"] for r in rep.collect() if not r["passed"]] == ["target_two_classes"]
    with pytest.raises(DataQualityError, match="target_two_classes"):
        PR.enforce(df, "f", target="ust")


def test_label_dictionary_over_several_ranges(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("v"), F.col("id") % 900)).alias("c"))
    d = PR.fit_labels(df, "c", part_rows=100)
    want = {v: i for i, v in enumerate(sorted({"missing"} | {f"v{i % 900}" for i in range(5000) if i % 50}))}
    assert {r["level"]: r["code"] for r in d.collect()} == want
    more = df.unionByName(spark.createDataFrame([(9999, "unseen")], "id long, c string"))
    out = PR.apply_labels(more, {"c": d})
    assert out.columns == ["id", "c"] and dict(out.dtypes)["c"] == "bigint"
    got = {r["id"]: r["c"] for r in out.collect()}
    assert len(got) == 5001 and got[9999] is None and got[0] == want["missing"] and got[901] == want["v1"]
