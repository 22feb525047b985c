"""What keeps the fits' cost in proportion: quantiles by counts, methods that the JVM compiles, rows held once for two versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import quantiles as Q
from quire.operators import train as TR
from quire.plans import catalog
from quire.session import configure


def test_quantiles_merge_counts_and_no_sketches(spark, monkeypatch):
    def refuse(*a, **kw):
        raise AssertionError("a sketch or a value map of a whole column is merged in one task")

    monkeypatch.setattr(F, "percentile_approx", refuse)
    monkeypatch.setattr(F, "percentile", refuse)
    monkeypatch.setattr(Q, "HELD_ROWS", 20)
    passes, cells = [], Q._cells
    monkeypatch.setattr(Q, "_cells", lambda *a: passes.append(len(a[2])) or cells(*a))
    r = np.random.default_rng(3)
    wide = r.normal(size=3000) * 10.0 ** r.integers(-300, 300, 3000)
    near = 1.0 + r.integers(0, 2 ** 20, 3000) * 2.0 ** -52  # differ in the last bits only
    edge = np.r_[np.inf, -np.inf, -0.0, 0.0, np.zeros(1000), np.nan, r.integers(-3, 4, 1995)]
    rows = [(float(a), float(b), None if np.isnan(c) else float(c), int(i % 5), None) for i, (a, b, c) in enumerate(zip(wide, near, edge))]
    df = spark.createDataFrame(rows, "wide double, near double, edge double, whole int, none double").repartition(6)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = Q.exact_quantiles(df, ["wide", "near", "edge", "whole", "none"], probs)
    np.testing.assert_allclose(got["wide"], np.quantile(wide, probs), rtol=1e-12)
    np.testing.assert_allclose(got["near"], np.quantile(near, probs), rtol=1e-15)
    held = np.sort(edge[~np.isnan(edge)])
    assert got["edge"][0] == -np.inf and got["edge"][-1] == np.inf and got["edge"][3] == held[(len(held) - 1) // 2]
    assert got["whole"] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 4.0] and got["none"] == [None] * 7
    assert 2 <= len(passes) <= 6
    assert Q.exact_quantiles(df.limit(1), ["whole"], (0.5,))["whole"][0] in range(5) and Q.exact_quantiles(df, [], (0.5,)) == {}


def test_wide_projections_stay_in_methods_the_jvm_compiles(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
        assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_two_versions_share_held_rows_of_the_models_columns(spark, tmp_dir, monkeypatch):
    keys = spark.range(1, 401).select(F.col("id").alias("c_custkey"))
    keys.write.parquet(tmp_dir + "/customer.parquet")
    spark.range(1600).select(F.col("id").alias("o_orderkey"), (F.col("id") % 400 + 1).alias("o_custkey"), F.when(
        F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus")).write.parquet(tmp_dir + "/orders.parquet")
    held, plain = [], TR.held
    monkeypatch.setattr(TR, "held", lambda df: held.append(df.columns) or plain(df))
    reg, _, columns = catalog._two_versions(spark, tmp_dir)
    assert held == [["fold", "ust", "w", "features"]] and {"user_id", "ust"} < set(columns)
    rows = {r["timestamp"]: r for r in reg.collect()}
    assert sorted(rows) == ["20250101_000000", "20250102_000000"]
    assert all(len(r["final_features"]) == len(catalog.MODEL_FEATURES) and 0 <= r["cv_f1"] <= 1 for r in rows.values())
    assert {r["model_path"][-1] for r in rows.values()} == {"1", "2"}


def test_fold_predictions_equal_those_of_out_of_fold(spark):
    df = spark.range(200, numPartitions=3).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("fold"),
        ((F.col("id") * 7) % 11 + F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("w"))
    params = {"n_trees": 3, "depth": 2}
    want = {r["id"]: r["p1"] for r in TR.out_of_fold(df, ["x"], "y", "fold", 4, params).collect()}
    with TR.held(TR.assemble(df, ["x"]).drop("x")) as rows:
        got = {r["id"]: r["p1"] for r in TR.fold_predictions(rows, "y", "fold", 4, params, parallelism=2).collect()}
    assert got == pytest.approx(want) and len(got) == 200
