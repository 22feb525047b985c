"""Two-phase publishing, refusal of tampered artifacts, explicit paths, concurrent promotions."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pytest

from quire.operators import publish as PB
from quire.operators import train as TR


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 3))
    pdf = pd.DataFrame(x, columns=list("abc")).assign(ust=(x[:, 0] > 0).astype(int))
    df = TR.with_class_weight(spark.createDataFrame(pdf), "ust", "balanced", "w")
    scaler = {c: {"mean": float(i), "scale": 1.0 + i} for i, c in enumerate("abcd")}
    return df, [TR.fit_forest(df, list("abc"), "ust", n_trees=n, depth=3) for n in (3, 5)], scaler


def prepared(spark, root, fitted, which=0, f1=0.5, std=0.05, stamp="20250101_000000"):
    _, models, scaler = fitted
    importances = list(zip("abc", models[which].featureImportances.toArray().tolist()))
    return PB.prepare(spark, root, models[which], scaler, importances, {"cv_f1": f1, "cv_score_std": std}, stamp)


def overwrite(spark, path, change):
    """Rewrite the first data file below ``path`` through the file system, so its own checks hold."""
    name = sorted(f for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).toPandas()["path"])[0]
    content = bytearray(spark.read.format("binaryFile").load(name).first()["content"])
    PB.rewrite(spark, name, change(content))


def test_publish_load_and_history(spark, tmp_dir, fitted):
    df, models, scaler = fitted
    assert PB.current(spark, tmp_dir) is None
    first = PB.promote(spark, tmp_dir, prepared(spark, tmp_dir, fitted), None)
    loaded = PB.load(spark, tmp_dir)
    assert first.number == 1 and loaded.features == list("abc") and loaded.scaler == scaler and loaded.decision_threshold == 0.5
    a, b = (m.transform(TR.assemble(df, list("abc"))).select("probability").collect() for m in (models[0], loaded.model))
    assert a == b
    assert {r["status"] for r in PB.statuses(spark, first).collect()} == {"ok"}
    # The gate: not better, then too unsteady, then better.
    base = PB.current(spark, tmp_dir)
    assert PB.promote(spark, tmp_dir, prepared(spark, tmp_dir, fitted, 1, f1=0.5), base) is None
    assert PB.promote(spark, tmp_dir, prepared(spark, tmp_dir, fitted, 1, f1=0.9, std=0.2), base) is None
    assert PB.current(spark, tmp_dir).number == 1
    assert PB.promote(spark, tmp_dir, prepared(spark, tmp_dir, fitted, 1, f1=0.6), base).number == 2
    assert PB.load(spark, tmp_dir).model.getNumTrees == 5


@pytest.mark.parametrize("kind", ["model", "scaler"])
def test_a_changed_byte_is_refused(spark, tmp_dir, fitted, kind):
    v = PB.promote(spark, tmp_dir, prepared(spark, tmp_dir, fitted), None)
    overwrite(spark, v.record[f"{kind}_path"], lambda c: c[:-1] + bytes([c[-1] ^ 1]))
    with pytest.raises(PB.TamperedArtifact, match="mismatch"):
        PB.load(spark, tmp_dir)
    assert {r["artifact"]: r["status"] for r in PB.statuses(spark, v).collect()}[kind] == "mismatch"


def test_explicit_paths_win(spark, tmp_dir, fitted):
    v = PB.promote(spark, tmp_dir, prepared(spark, tmp_dir, fitted), None)
    other = prepared(spark, tmp_dir, fitted, 1)
    got = PB.load(spark, tmp_dir, f"{other}/model", f"{other}/scaler")
    assert got.model.getNumTrees == 5 and got.features == list("abc")
    assert PB.load(spark, tmp_dir, f"{other}/model").model.getNumTrees == 3  # both or none
    with pytest.raises(PB.TamperedArtifact):
        PB.load(spark, tmp_dir, f"{other}/model", f"{other}/scaler", {"model_checksum": v.record["model_checksum"]})
    with pytest.raises(PB.TamperedArtifact):
        PB.load(spark, tmp_dir, f"{tmp_dir}/nothing", f"{tmp_dir}/there")
    with pytest.raises(PB.TamperedArtifact):
        PB.load(spark, f"{tmp_dir}/empty")


def test_of_two_promotions_from_one_version_one_stays(spark, tmp_dir, fitted):
    folders = [prepared(spark, tmp_dir, fitted, i, f1=0.5 + i / 10) for i in (0, 1)]

    def go(folder):
        try:
            return PB.promote(spark, tmp_dir, folder, None)
        except PB.StaleVersion:
            return "stale"

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(go, folders))
    assert got.count("stale") == 1 and PB.current(spark, tmp_dir).number == 1
    with pytest.raises(PB.StaleVersion):
        PB.publish(spark, tmp_dir, folders[0], None)
