"""Publishing model versions and loading them checked (C10, C11, C14; used by W5).

A version is published in two phases.  First its model, scaler and record are
written below a folder of their own, with checksums of what was written.  Then
the version becomes current by creating the marker of the next version number, which
must not exist: of several publishers that started from one version, one succeeds
and the others get ``StaleVersion``.  The marker is as atomic as the store's
exclusive create (HDFS, object stores with conditional writes).  A publisher that dies
between the phases leaves files that no marker names.

Loading resolves the current version, or paths given explicitly, and recomputes the
checksums of model and scaler: a changed, added or missing byte refuses the load.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import registry as RG


class StaleVersion(RuntimeError):
    """Another version was published since the one that a publisher started from."""


class TamperedArtifact(ValueError):
    """An artifact is missing or is not what was published."""


@dataclass
class Version:
    """A published version: its number and record (a row of the registry schema)."""

    number: int
    record: dict


@dataclass
class Loaded:
    """What scoring needs."""

    model: RandomForestClassificationModel
    scaler: dict
    features: list[str]
    decision_threshold: float


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def rewrite(spark: SparkSession, path: str, content: bytes) -> None:
    """Replace a file through its file system."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(content))
    out.close()


def _marker(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/versions/{number:08d}"


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, or of a folder's file names and their SHA-256; empty if nothing is there."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return ""
    row = spark.createDataFrame([(path, "")], "model_path string, scaler_path string")
    return RG.resolve_artifacts(row, RG.manifest(spark, path)).first()["model_checksum"]


def current(spark: SparkSession, root: str) -> Version | None:
    """The version of the highest marker; None before the first."""
    fs, p = _fs(spark, f"{root.rstrip('/')}/versions")
    if not fs.exists(p):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.getLen() > 0 and s.getPath().getName().isdigit()), reverse=True)
    if not names:
        return None
    folder = spark.read.text(f"{p.toString()}/{names[0]}", wholetext=True).first()[0].strip()
    return Version(int(names[0]), spark.read.parquet(f"{folder}/record").first().asDict(recursive=True))


def prepare(spark: SparkSession, root: str, model, scaler: dict, importances: list[tuple], metrics: dict, timestamp: str,
            config: dict | None = None) -> str:
    """Phase one: write the artifacts, their checksums and the record; returns the version's folder."""
    folder = f"{root.rstrip('/')}/artifacts/{uuid.uuid4().hex}"
    paths = {"model_path": f"{folder}/model", "scaler_path": f"{folder}/scaler"}
    model.write().save(paths["model_path"])
    rows = [(f, float(p["mean"]), float(p["scale"])) for f, p in sorted(scaler.items())]
    spark.createDataFrame(rows, "feature string, mean double, scale double").coalesce(1).write.parquet(paths["scaler_path"])
    for kind in ("model", "scaler"):
        paths[f"{kind}_checksum"] = checksum(spark, paths[f"{kind}_path"])
    RG.registry_row(spark, metrics, importances, paths, timestamp, config).coalesce(1).write.parquet(f"{folder}/record")
    return folder


def publish(spark: SparkSession, root: str, folder: str, based_on: Version | None) -> Version:
    """Phase two: make ``folder`` the version after ``based_on``, if that is still the current one."""
    number = (based_on.number if based_on else 0) + 1
    fs, p = _fs(spark, _marker(root, number))
    fs.mkdirs(p.getParent())
    if fs.exists(p) or (seen := current(spark, root)) and seen.number >= number:
        raise StaleVersion(f"version {number} has been published by another")
    try:
        out = fs.create(p, False)  # fails if another has created it
    except Exception as e:
        raise StaleVersion(f"version {number} has been published by another") from e
    out.write(bytearray(folder.encode("utf-8")))
    out.close()
    return Version(number, spark.read.parquet(f"{folder}/record").first().asDict(recursive=True))


def promote(spark: SparkSession, root: str, folder: str, based_on: Version | None, scoring_key: str = "cv_f1",
            std_key: str = "cv_score_std") -> Version | None:
    """Publish ``folder`` if its record passes the gate against ``based_on``; None if it does not."""
    new = spark.read.parquet(f"{folder}/record").first().asDict()
    row = spark.read.parquet(f"{folder}/record").limit(0) if based_on is None else spark.createDataFrame(
        [based_on.record], spark.read.parquet(f"{folder}/record").schema)
    if not RG.promotion_gate(None if based_on is None else row, new[scoring_key], new[std_key], scoring_key):
        return None
    return publish(spark, root, folder, based_on)


def resolve(spark: SparkSession, root: str, model_path: str | None = None, scaler_path: str | None = None) -> dict:
    """C14: paths, checksums, features and threshold.  Model and scaler paths given together win over the
    registry's, with the checksums they have now; the rest is the current version's, with defaults."""
    version = current(spark, root)
    record = {**RG.CONFIG_DEFAULTS, **{k: v for k, v in (version.record if version else {}).items() if v is not None}}
    out = {k: record.get(k, "") for k in ("model_path", "model_checksum", "scaler_path", "scaler_checksum")}
    if model_path and scaler_path:
        out = {"model_path": model_path, "model_checksum": checksum(spark, model_path),
               "scaler_path": scaler_path, "scaler_checksum": checksum(spark, scaler_path)}
    return out | {"features": [f["feature"] for f in record.get("final_features", [])],
                  "decision_threshold": record["decision_threshold"]}


def load(spark: SparkSession, root: str, model_path: str | None = None, scaler_path: str | None = None,
         expected: dict | None = None) -> Loaded:
    """C11: the artifacts that ``resolve`` names, after checking them; ``expected`` may hold checksums of explicit paths."""
    found = {**resolve(spark, root, model_path, scaler_path), **(expected or {})}
    for kind in ("model", "scaler"):
        want, path = found[f"{kind}_checksum"], found[f"{kind}_path"]
        if not path or not want:
            raise TamperedArtifact(f"no {kind} with a checksum to verify")
        if checksum(spark, path) != want:
            raise TamperedArtifact(f"checksum mismatch for {path}")
    model = RandomForestClassificationModel.load(found["model_path"])
    rows = spark.read.parquet(found["scaler_path"]).collect()  # one row for each feature
    return Loaded(model, {r["feature"]: {"mean": r["mean"], "scale": r["scale"]} for r in rows}, found["features"],
                  found["decision_threshold"])


def statuses(spark: SparkSession, version: Version) -> DataFrame:
    """C11 as a table: each artifact of a version with its published and present checksum."""
    rows = [(k, version.record[f"{k}_checksum"], checksum(spark, version.record[f"{k}_path"])) for k in ("model", "scaler")]
    return spark.createDataFrame(rows, "artifact string, sha256 string, actual string").withColumn(
        "status", F.when(F.col("actual") == "", "missing").when(F.col("actual") != F.col("sha256"), "mismatch").otherwise("ok"))
