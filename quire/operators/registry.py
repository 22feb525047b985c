"""Model registry as a table (S9, S10, C9-C11, C14) and sinks.

One row per trained model: metrics, configuration, features with their
importances (native ARRAY<STRUCT>), artifact paths and checksums.  The
registry is appended to, never rewritten; "latest" is an aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

METRIC_KEYS = [
    "cv_roc_auc", "cv_accuracy", "cv_precision", "cv_recall", "cv_f1", "cv_score_mean",
    "cv_score_std", "test_roc_auc", "test_accuracy", "test_precision", "test_recall", "test_f1",
    "overfitting_gap", "accuracy_ci_lower", "accuracy_ci_upper", "precision_ci_lower",
    "precision_ci_upper", "recall_ci_lower", "recall_ci_upper", "f1_ci_lower", "f1_ci_upper",
    "roc_auc_ci_lower", "roc_auc_ci_upper", "cost_loss"]
CONFIG_DEFAULTS = {  # back-filled into older rows that lack the columns
    "decision_threshold": 0.5, "scoring": "f1", "n_features_to_select": 10, "n_folds": 5,
    "random_state": 42, "oversampling_method": "borderline", "use_undersampling": False,
    "max_vif": 1.5, "n_bootstraps": 500, "alpha": 0.05, "test_size": 0.2}
FEATURES_TYPE = "array<struct<feature:string,importance:double>>"

REGISTRY_SCHEMA = (", ".join(f"{m} DOUBLE" for m in METRIC_KEYS)
                   + f", final_features {FEATURES_TYPE}, model_path STRING, model_checksum STRING,"
                   " scaler_path STRING, scaler_checksum STRING, timestamp STRING,"
                   " decision_threshold DOUBLE, scoring STRING, n_features_to_select INT, n_folds INT,"
                   " random_state INT, oversampling_method STRING, use_undersampling BOOLEAN,"
                   " max_vif DOUBLE, n_bootstraps INT, alpha DOUBLE, test_size DOUBLE,"
                   " package_versions map<string,string>")


def registry_row(spark, metrics: dict, importances: list[tuple], paths: dict, timestamp: str,
                 config: dict | None = None, versions: dict | None = None) -> DataFrame:
    """The one-row registry record (metric NaN/negative -> 0, E12)."""
    cfg = {**CONFIG_DEFAULTS, **(config or {})}
    vals = []
    for m in METRIC_KEYS:
        v = metrics.get(m)
        vals.append(0.0 if v is None or v != v or v < 0 else float(v))
    row = tuple(vals) + (
        [(f, float(i)) for f, i in importances], paths.get("model_path", ""),
        paths.get("model_checksum", ""), paths.get("scaler_path", ""), paths.get("scaler_checksum", ""),
        timestamp, float(cfg["decision_threshold"]), cfg["scoring"], int(cfg["n_features_to_select"]),
        int(cfg["n_folds"]), int(cfg["random_state"]), cfg["oversampling_method"],
        bool(cfg["use_undersampling"]), float(cfg["max_vif"]), int(cfg["n_bootstraps"]),
        float(cfg["alpha"]), float(cfg["test_size"]), versions or {})
    return spark.createDataFrame([row], REGISTRY_SCHEMA)


def append(row: DataFrame, path: str) -> None:
    """Append to the registry / predictions table."""
    row.write.mode("append").parquet(path)


def to_csv_view(df: DataFrame) -> DataFrame:
    """S9 CSV form: list/map fields JSON-encoded."""
    return df.select(*[F.to_json(F.col(c)).alias(c) if t.startswith(("array", "map", "struct"))
                       else F.col(c) for c, t in df.dtypes])


def read_csv_registry(spark, path: str) -> DataFrame:
    """Read CSV rows (BOM-tolerant, doubled quotes), decode JSON fields;
    bad JSON -> empty list / map; absent config columns get defaults."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    out = raw
    if "final_features" in raw.columns:
        out = out.withColumn("final_features", F.coalesce(
            F.from_json("final_features", FEATURES_TYPE), F.array().cast(FEATURES_TYPE)))
    if "package_versions" in raw.columns:
        out = out.withColumn("package_versions", F.coalesce(
            F.from_json("package_versions", "map<string,string>"),
            F.create_map().cast("map<string,string>")))
    for m in METRIC_KEYS:
        if m in out.columns:
            v = F.col(m).try_cast("double")
            out = out.withColumn(m, F.when(v.isNull() | F.isnan(v) | (v < 0), 0.0).otherwise(v))
        else:
            out = out.withColumn(m, F.lit(0.0))
    for k, v in CONFIG_DEFAULTS.items():
        if k not in out.columns:
            out = out.withColumn(k, F.lit(v))
    # CSV cells are text: back to the registry's types (what does not parse becomes NULL)
    types = {f.name: f.dataType for f in StructType.fromDDL(REGISTRY_SCHEMA).fields}
    return out.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types and t == "string" else F.col(c)
                        for c, t in out.dtypes])


def latest(reg: DataFrame) -> DataFrame:
    """The newest row by timestamp (yyyyMMdd_HHmmss sorts as text);
    one aggregation, no sort of the registry."""
    cols = [c for c in reg.columns]
    best = reg.agg(F.max_by(F.struct(*cols), F.col("timestamp")).alias("r")).where("r is not null").select("r.*")
    return best.select(*[F.coalesce(F.col(k), F.lit(CONFIG_DEFAULTS[k])).alias(k) if k in CONFIG_DEFAULTS else F.col(k)
                         for k in cols])


def promotion_gate(latest_row: DataFrame | None, new_score: float, new_std: float,
                   scoring_key: str = "cv_f1") -> bool:
    """Promote when there is no prior model, or the new CV score is
    strictly greater and its CV std is below 0.10."""
    if latest_row is None:
        return True
    r = latest_row.select(scoring_key, "model_path").first()
    if r is None or not r["model_path"]:
        return True
    return bool(new_score > (r[scoring_key] or 0.0) and new_std < 0.10)


def manifest(spark, root: str) -> DataFrame:
    """C11: (path, length, sha256) of every artifact file under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.col("path"), F.col("length"), F.sha2(F.col("content"), 256).alias("sha256"))


def verify(manifest_df: DataFrame, expected: DataFrame) -> DataFrame:
    """C11 verify: expected (path, sha256) vs actual; status per file."""
    m = manifest_df.select("path", F.col("sha256").alias("actual"))
    j = expected.join(m, "path", "left")
    return j.select("path", "sha256", "actual", F.when(F.col("actual").isNull(), "missing")
                    .when(F.col("actual") != F.col("sha256"), "mismatch").otherwise("ok").alias("status"))


def _plain_path(c):
    """A path without its ``file:`` scheme, doubled or trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "(?<!:)/{2,}", "/")
    return F.when(F.length(bare) > 1, F.regexp_replace(bare, "/$", "")).otherwise(bare)


def resolve_artifacts(latest_row: DataFrame, manifest_df: DataFrame) -> DataFrame:
    """C14: registry paths joined to the manifest; missing artifacts blanked.

    An artifact is a file or a folder of files (MLlib's layout); a folder's
    checksum is the SHA-256 over its files' names and checksums in order.
    Scheme and slashes are normalised on both sides."""
    files = manifest_df.select(_plain_path(F.col("path")).alias("path"), "sha256")
    wanted = latest_row.select(F.explode(F.array(*[_plain_path(F.col(f"{k}_path")) for k in ("model", "scaler")]))
                               .alias("_p")).where("_p <> ''").distinct()
    inside = files.join(F.broadcast(wanted), (F.col("path") == F.col("_p"))
                        | F.col("path").startswith(F.concat(F.col("_p"), F.lit("/"))))
    part = F.struct(F.col("path").substr(F.length("_p") + 1, F.length("path")).alias("name"), "sha256")
    ordered = F.array_sort(F.collect_list(part))
    present = inside.groupBy("_p").agg(F.when(
        (F.count(F.lit(1)) == 1) & (F.max(F.col("path") == F.col("_p"))), F.max("sha256")).otherwise(F.sha2(
            F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit(" "), x["sha256"])), "\n"), 256)).alias("_s"))
    out = latest_row
    for kind in ("model", "scaler"):
        p = present.withColumnRenamed("_p", f"_p_{kind}").withColumnRenamed("_s", f"_s_{kind}")
        out = out.join(p, _plain_path(F.col(f"{kind}_path")) == F.col(f"_p_{kind}"), "left")
        out = out.withColumn(f"{kind}_path", F.when(F.col(f"_p_{kind}").isNull(), F.lit(""))
                             .otherwise(F.col(f"{kind}_path")))
        out = out.withColumn(f"{kind}_checksum", F.coalesce(F.col(f"_s_{kind}"), F.lit("")))
        out = out.drop(f"_p_{kind}", f"_s_{kind}")
    return out


# ------------------------------------------------------------------ sinks
def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Stage snapshot (parquet by default, CSV with a header on request)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def write_json_records(df: DataFrame, path: str) -> None:
    """JSON records, written by the executors."""
    df.write.mode("overwrite").json(path)


def pending(new_customers: DataFrame, predictions: DataFrame, key: str = "customer_id") -> DataFrame:
    """The next pending set = customers without a prediction (no
    in-place UPDATE: an anti-join against the append-only predictions)."""
    return new_customers.join(predictions.select(key).distinct(), key, "left_anti")


def members(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Index-membership filter as a left-semi join."""
    return df.join(keys.select(key), key, "left_semi")
