"""Resampling properties, kNN vs brute force, registry and streaming."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import registry as RG
from quire.operators import resample as R

RNG = np.random.default_rng(3)


def _labelled(spark, n=1000, minority=0.15):
    y = (RNG.random(n) < minority).astype(int)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "label": y})), y


def test_split_folds_counts_and_determinism(spark):
    df, y = _labelled(spark)
    s = R.stratified_split(df, "label", "id", 0.2, 42)
    n_test = s.where("is_test").count()
    assert n_test == int(np.ceil(0.2 * len(y)))
    a = sorted(r[0] for r in s.where("is_test").select("id").collect())
    b = sorted(r[0] for r in R.stratified_split(df, "label", "id", 0.2, 42).where("is_test").select("id").collect())
    assert a == b
    per = {r[0]: r[1] for r in s.where("is_test").groupBy("label").count().collect()}
    assert abs(per[1] - 0.2 * y.sum()) <= 1
    folds = R.stratified_folds(df, "label", "id", 5).groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        sizes = [r["count"] for r in folds if r["label"] == lab]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == (y == lab).sum()


def test_over_under_sampling_counts(spark):
    df, y = _labelled(spark)
    over = R.oversample_random(df, "label", "id")
    c = {r[0]: r[1] for r in over.groupBy("label").count().collect()}
    assert c[0] == c[1] == (y == 0).sum()
    src = set(r[0] for r in df.where("label = 1").select("id").collect())
    assert set(r[0] for r in over.where("synthetic").select("id").collect()) <= src
    under = R.undersample(df, "label", "id")
    c = {r[0]: r[1] for r in under.groupBy("label").count().collect()}
    assert c[0] == c[1] == (y == 1).sum()


@pytest.mark.parametrize("as_text", [False, True])
def test_selected_rows_are_those_of_least_rank(spark, as_text):
    df, _ = _labelled(spark, 3000)
    df = df.withColumn("id", F.concat(F.lit("k"), "id")) if as_text else df
    counts = R.class_counts(df, "label")
    for take in ({0: 700, 1: 31}, {0: 1, 1: counts[1]}, {0: 0, 1: counts[1] - 1}):
        got = df.where(R.first_of_class(df, "label", "id", take, counts, 7))
        tk = F.when(F.col("label") == 0, take[0]).otherwise(take[1])
        want = R.hash_rank(df, "label", "id", 7).where(F.col("rank") <= tk)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.select("id").collect())


def test_split_and_undersample_move_no_wide_row(spark):
    df, y = _labelled(spark)
    wide = df.withColumn("payload", F.repeat(F.lit("x"), 100))
    for out in (R.stratified_split(wide, "label", "id"), R.undersample(wide, "label", "id")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_copies_of_a_key_and_null_keys_keep_the_counts_exact(spark):
    rows = [(7, 0)] * 40 + [(None, 0)] * 10 + [(i, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, label int")
    assert R.first_of_class(df, "label", "id", {0: 20, 1: 20}, {0: 50, 1: 20}) is None
    c = {r[0]: r[1] for r in R.undersample(df, "label", "id").groupBy("label").count().collect()}
    assert c == {0: 20, 1: 20}
    s = R.stratified_split(df, "label", "id", 0.2)
    assert s.where("is_test").count() == 14 and s.count() == 70
    assert R.random_split(df, "id", 0.5).where("is_test").count() == 35


@pytest.mark.parametrize("method", ["smote", "borderline", "adasyn"])
def test_smote_family_balanced_and_on_segments(spark, method):
    n = 200
    x = RNG.normal(size=(n, 3))
    y = (RNG.random(n) < 0.2).astype(int)
    x[y == 1] += 1.0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "label": y, "v": list(x)}))
    out = R.smote_family(df, "label", "id", "v", method).toPandas()
    c = out.groupby("label").size()
    if method == "smote":
        assert c[0] == c[1]
    assert c[1] <= c[0]
    mino = x[y == 1]
    for v in out[out.synthetic].v.head(30):
        v = np.asarray(v)
        # on a segment between two minority points: some pair (a, b) with
        # v = a + u (b - a), 0 <= u <= 1
        ok = False
        for a in mino:
            d = v - a
            for b in mino:
                e = b - a
                den = e @ e
                if den == 0:
                    continue
                u = (d @ e) / den
                if -1e-9 <= u <= 1 + 1e-9 and np.allclose(a + u * e, v, atol=1e-7):
                    ok = True
                    break
            if ok:
                break
        assert ok


def test_registry_roundtrip(spark, tmp_dir):
    r1 = RG.registry_row(spark, {"cv_f1": 0.8, "test_f1": float("nan"), "cv_score_std": 0.05},
                         [("a", 0.7), ("b", 0.3)], {"model_path": "m1"}, "20250101_000000")
    r2 = RG.registry_row(spark, {"cv_f1": 0.9, "cv_score_std": 0.05}, [("a", 1.0)], {"model_path": "m2"},
                         "20250102_000000")
    path = os.path.join(tmp_dir, "reg")
    RG.append(r1, path)
    RG.append(r2, path)
    reg = spark.read.parquet(path)
    last = RG.latest(reg).first()
    assert last["model_path"] == "m2"
    assert r1.first()["test_f1"] == 0.0
    assert RG.promotion_gate(RG.latest(reg), 0.95, 0.05) is True
    assert RG.promotion_gate(RG.latest(reg), 0.95, 0.2) is False
    assert RG.promotion_gate(None, 0.1, 0.5) is True
    csv = os.path.join(tmp_dir, "csv")
    RG.to_csv_view(reg).coalesce(1).write.option("header", True).option("escape", '"').csv(csv)
    back = RG.read_csv_registry(spark, csv)
    rows = {r["model_path"]: r for r in back.collect()}
    assert rows["m1"]["final_features"][0]["feature"] == "a"
    bad = os.path.join(tmp_dir, "bad.csv")
    with open(bad, "w", encoding="utf-8-sig") as f:
        f.write('cv_f1,final_features,model_path,timestamp\n0.5,"not json",m3,20240101_000000\n')
    b = RG.read_csv_registry(spark, bad).first()
    assert b["final_features"] == [] and b["max_vif"] == 1.5 and b["cv_f1"] == 0.5


def test_manifest_detects_changes(spark, tmp_dir):
    d = os.path.join(tmp_dir, "art")
    os.makedirs(d)
    for n, t in (("a.bin", b"abc"), ("b.bin", b"xyz")):
        with open(os.path.join(d, n), "wb") as f:
            f.write(t)
    man = RG.manifest(spark, d)
    exp = spark.createDataFrame(man.select("path", "sha256").collect(), "path string, sha256 string")
    with open(os.path.join(d, "b.bin"), "wb") as f:
        f.write(b"changed")
    st = {os.path.basename(r["path"]): r["status"] for r in RG.verify(RG.manifest(spark, d), exp).collect()}
    assert st == {"a.bin": "ok", "b.bin": "mismatch"}
