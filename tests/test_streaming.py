"""Streaming output equals batch output; a restart adds no duplicates."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quire.operators import train as TR
from quire.plans.jobs import batch_score
from quire.sources import fixtures as FX
from quire.streaming import scoring
from quire.streaming.scoring import start_scoring_stream
from tests.conftest import SF_SMALL


def _model(spark):
    rng = np.random.default_rng(1)
    feats = ["loan_score_avg", "fht1", "kmsi2"]
    pdf = pd.DataFrame(rng.integers(1, 4, size=(200, 3)).astype(float), columns=feats)
    pdf["ust"] = (pdf["fht1"] + rng.normal(size=200) > 2).astype(int)
    df = TR.with_class_weight(spark.createDataFrame(pdf), "ust", "balanced", "w")
    model = TR.fit_forest(df, feats, "ust", n_trees=5, depth=3)
    return model, {f: {"mean": 2.0, "scale": 1.0} for f in feats}, feats


def test_stream_matches_batch_and_replays_cleanly(spark, tmp_dir):
    model, scaler, feats = _model(spark)
    req = FX.payloads(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "requests")
    for part in range(3):
        req.where(F.pmod(F.col("resp_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(src)
    out, ckpt = os.path.join(tmp_dir, "scored"), os.path.join(tmp_dir, "ckpt")
    start_scoring_stream(spark, src, req.schema, out, ckpt, model, scaler, feats).awaitTermination()
    streamed = spark.read.parquet(out).drop("batch_id")
    batch = batch_score(req, model, scaler, feats)
    cols = sorted(batch.columns)
    s = sorted((tuple(r) for r in streamed.select(*cols).collect()), key=repr)
    b = sorted((tuple(r) for r in batch.select(*cols).collect()), key=repr)
    assert s == b and len(s) == req.count()
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3
    # restart over the same checkpoint and source: nothing new, no duplicates
    start_scoring_stream(spark, src, req.schema, out, ckpt, model, scaler, feats).awaitTermination()
    assert spark.read.parquet(out).count() == len(s)
    # a later file repeats ids of earlier batches, twice, beside new ones
    old = req.orderBy("resp_id").limit(5)
    new = old.withColumn("resp_id", F.col("resp_id") + 10_000_000)
    old.unionByName(old).unionByName(new).coalesce(1).write.mode("append").parquet(src)
    start_scoring_stream(spark, src, req.schema, out, ckpt, model, scaler, feats).awaitTermination()
    ids = [r[0] for r in spark.read.parquet(out).select("resp_id").collect()]
    assert len(ids) == len(set(ids)) == len(s) + 5
    # the output of one checkpoint is refused to another
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        start_scoring_stream(spark, src, req.schema, out, os.path.join(tmp_dir, "other"), model, scaler, feats).awaitTermination()
    assert spark.read.parquet(out).count() == len(ids)


def test_a_batch_replayed_after_a_failure_replaces_its_output(spark, tmp_dir, monkeypatch):
    model, scaler, feats = _model(spark)
    req = FX.payloads(spark, SF_SMALL)
    src, out, ckpt = (os.path.join(tmp_dir, x) for x in ("requests", "scored", "ckpt"))
    first = req.orderBy("resp_id").limit(8)
    first.coalesce(1).write.mode("append").parquet(src)
    first.unionByName(req.orderBy(F.desc("resp_id")).limit(4)).coalesce(1).write.mode("append").parquet(src)
    real, seen = scoring.batch_score, []

    def failing(batch, *a, **k):
        seen.append(sorted(r[0] for r in batch.select("resp_id").collect()))
        if len(seen) == 2:
            raise RuntimeError("executor lost")
        return real(batch, *a, **k)

    monkeypatch.setattr(scoring, "batch_score", failing)
    with pytest.raises(StreamingQueryException):
        start_scoring_stream(spark, src, req.schema, out, ckpt, model, scaler, feats).awaitTermination()
    start_scoring_stream(spark, src, req.schema, out, ckpt, model, scaler, feats).awaitTermination()
    assert len(seen) == 3 and seen[1] == seen[2]  # the same rows again
    ids = [r[0] for r in spark.read.parquet(out).select("resp_id").collect()]
    assert len(ids) == len(set(ids)) == 12
