"""Batch scoring (C3-C5, C7, C8): one DataFrame in, one row out per input.

The model and scaler parameters are loaded once and applied as a lazy
projection + ``model.transform``; nothing is collected per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.exprs import any_of
from quire.operators.train import assemble, probability_of_one
from quire.spec import ADJUSTED_THRESHOLD, SPEC_REGISTRY


def scaling_guard(df: DataFrame, scaler: dict) -> Column:
    """C3 guard: NULL / NaN / inf in any provided scaler feature -> reason."""
    present = [c for c in scaler if c in df.columns]
    if not present:
        return F.lit("no scaler features present")
    bad = any_of([F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                  | (F.abs(F.col(c).cast("double")) == float("inf")) for c in present])
    return F.when(bad, F.lit("non-finite or missing feature value"))


def scale_for_model(df: DataFrame, scaler: dict, features: list[str]) -> DataFrame:
    """Features missing from the input take the training mean; extra
    columns are ignored; then (x - mean) / scale for the model features."""
    out = df
    for c, p in scaler.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(float(p["mean"])))
    missing = [f for f in features if f not in scaler]
    if missing:
        raise ValueError(f"model features without scaler parameters: {missing}")
    keep = [c for c in df.columns if c not in features]
    return out.select(*keep, *[((F.col(f).cast("double") - F.lit(float(scaler[f]["mean"])))
                                / F.lit(float(scaler[f]["scale"]))).alias(f) for f in features])


def predict(df: DataFrame, model, features: list[str], adjusted_threshold: float = ADJUSTED_THRESHOLD,
            key: str = "user_id") -> DataFrame:
    """Guard, scale, predict.  Valid rows get the model's class,
    p(class 1), the adjusted class at p >= threshold and the rounded
    probability; rejected rows keep NULL predictions and the reason."""
    return _predict(df, model, features, adjusted_threshold)


def _predict(df, model, features, thr):
    ok = df.where(F.col("reject_reason").isNull())
    bad = df.where(F.col("reject_reason").isNotNull())
    scored = probability_of_one(model.transform(assemble(ok, features)))
    scored = scored.select(*df.columns,
                           F.round(F.col("p1"), 3).alias("default_probability"),
                           F.col("prediction").cast("int").alias("model_prediction"),
                           (F.col("p1") >= thr).cast("int").alias("adjust_prediction"))
    nulls = bad.select(*df.columns, F.lit(None).cast("double").alias("default_probability"),
                       F.lit(None).cast("int").alias("model_prediction"),
                       F.lit(None).cast("int").alias("adjust_prediction"))
    return scored.unionByName(nulls).withColumn(
        "used_features", F.array(*[F.lit(f) for f in features]))


def route(requests: DataFrame, label_col: str = "application_label") -> DataFrame:
    """Join requests to the spec routing table; unknown labels get a
    reject reason.  The routing table is the (tiny, fixed) spec registry."""
    spark = requests.sparkSession
    table = spark.createDataFrame([(k, v.name) for k, v in SPEC_REGISTRY.items()],
                                  f"{label_col} STRING, spec STRING")
    j = requests.join(F.broadcast(table), label_col, "left")
    return j.withColumn("route_reason", F.when(F.col("spec").isNull(), F.concat(
        F.lit("Unsupported application_label: "), F.coalesce(F.col(label_col), F.lit("")))))
