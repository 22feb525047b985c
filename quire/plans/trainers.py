"""The alternative training chains.

``logistic_chain`` (R1 -> T7 -> M2 -> E10 with cross-validated figures),
``forest_chain`` (R1 -> R3 -> M3 -> T6 -> E1-E6, E9) and ``legacy_chain``
(S3 -> R1 -> M1 -> E3, E4, E6 -> T9).  Their inputs are DataFrames, their results a
fitted model, its features and a dict of figures.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import evaluate as E
from quire.operators import resample as R
from quire.operators import train as TR
from quire.operators.prepare import DataQualityError
from quire.plans.jobs import oversample_frame
from quire.session import compact
from quire.sources.survey import legacy_cohort


@dataclass
class Trained:
    model: object
    features: list
    metrics: dict
    importances: list = field(default_factory=list)  # (feature, value), falling
    report: DataFrame | None = None                  # E10 on the test rows


def figures_table(spark: SparkSession, metrics: dict) -> DataFrame:
    """(metric, value) rows; a list gives one numbered row for each value."""
    rows = []
    for k, v in metrics.items():
        rows += [(f"{k}_{i}", x) for i, x in enumerate(v)] if isinstance(v, list) else [(k, v)]
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "metric STRING, value DOUBLE")


def _two_classes(df: DataFrame, label: str) -> None:
    n = df.agg(F.count_distinct(label)).first()[0]
    if n != 2:
        raise DataQualityError(f"target {label} must have exactly two classes, found {n}")


def _auc(df: DataFrame, label: str):
    return E.roc_auc(E.score_cells(df, label, "p1")).first()["roc_auc"]


def _decided(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("pred", E.decide(F.col("p1"), threshold))


def test_figures(scored: DataFrame, label: str, zero_division: float = 1.0) -> dict:
    """E3, E4 and E5 of test rows with ``p1`` and ``pred``."""
    m = E.count_metrics(scored, label, "pred", zero_division).first()
    cells = E.score_cells(scored, label, "p1")
    return {**{f"test_{k}": m[k] for k in ("accuracy", "precision", "recall", "f1")},
            "test_roc_auc": E.roc_auc(cells).first()["roc_auc"], "test_pr_auc": E.pr_auc(cells).first()["pr_auc"]}


def cross_validated(oof: DataFrame, label: str, k: int, threshold: float = 0.5, zero_division: float = 1.0,
                    scoring: str = "roc_auc") -> dict:
    """Figures of out-of-fold predictions (``fold``, ``p1``): over all rows together, and ``cv_scores`` for each
    fold by ``scoring`` (E6) with their mean and population deviation.

    A fold without both classes has no ROC AUC; its score is None and takes no part in the mean.
    """
    held = _decided(oof, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m = E.count_metrics(held, label, "pred", zero_division).first()
        out = {f"cv_{x}": m[x] for x in ("accuracy", "precision", "recall", "f1")}
        out["cv_roc_auc"] = _auc(held, label)
        if scoring == "roc_auc":
            scores = [_auc(held.where(F.col("fold") == f), label) for f in range(k)]
        else:
            per = {r["fold"]: r[scoring] for r in E.count_metrics(held, label, "pred", zero_division, by=["fold"]).collect()}
            scores = [per.get(f) for f in range(k)]
    finally:
        held.unpersist()
    known = [s for s in scores if s is not None]
    return out | {"cv_scores": scores, "cv_score_mean": float(np.mean(known)) if known else None,
                  "cv_score_std": float(np.std(known)) if known else None}


test_figures.__test__ = False  # not a test of pytest's


def logistic_chain(frame: DataFrame, candidates: list[str], key: str = "user_id", label: str = "ust",
                   test_size: float = 0.2, n_folds: int = 5, seed: int = 42, threshold: float = 0.5,
                   cross_validate: bool = True) -> Trained:
    """Backward elimination of a balanced logistic model on one stratified split.

    The model returned is fitted on the training rows.  Cross-validation
    goes over all rows with the features kept; class weights are those of all rows, which
    stratified folds share up to a row.
    """
    if not candidates:
        raise DataQualityError("no feature was selected")
    _two_classes(frame, label)
    rows = TR.with_class_weight(frame.select(key, *candidates, label), label, "balanced", "w")
    rows = R.stratified_folds(rows, label, key, n_folds, seed)
    rows = R.stratified_split(rows, label, key, test_size, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = rows.where(~F.col("is_test")), rows.where("is_test")
        n = train.count()
        kept, auc = TR.backward_elimination(train, test, candidates, label, n_rows=n)
        model = TR.logistic(label, "w", n_rows=n).fit(TR.assemble(train, kept))
        scored = _decided(TR.probability_of_one(model.transform(TR.assemble(test, kept))), threshold)
        # the report outlives the rows that are released here
        report = E.per_class_report(scored.withColumnRenamed(label, "label"))
        report = frame.sparkSession.createDataFrame(report.collect(), report.schema)
        metrics = test_figures(scored, label)
        if cross_validate:
            oof = TR.out_of_fold(rows, kept, label, "fold", n_folds,
                                 estimator=lambda part: TR.logistic(label, "w", n_rows=part.count()))
            metrics |= cross_validated(oof, label, n_folds, threshold)
    finally:
        rows.unpersist()
    weight = sorted(zip(kept, [abs(float(x)) for x in model.coefficients.toArray()]), key=lambda t: (-t[1], t[0]))
    return Trained(model, kept, metrics | {"elimination_roc_auc": auc}, weight, report)


def forest_chain(frame: DataFrame, candidates: list[str], cfg: TR.ModelConfig, key: str = "user_id",
                 label: str = "ust") -> Trained:
    """Forest with tuned parameters and recursive elimination to max(n, p / 2) features.

    Only the training rows are oversampled, tuned on and eliminated on; the
    test rows give the test figures and their bootstrap intervals (E9)."""
    if not candidates:
        raise DataQualityError("no feature was selected")
    _two_classes(frame, label)
    spark = frame.sparkSession
    rows = R.stratified_split(frame.select(key, *candidates, label), label, key, cfg.test_size,
                              cfg.random_state).persist(StorageLevel.MEMORY_AND_DISK)
    train = oversample_frame(rows.where(~F.col("is_test")).drop("is_test"), candidates, label, key,
                             cfg.oversampling_method, cfg.random_state, cfg.categorical_features)
    folded = R.stratified_folds(train, label, key, cfg.n_folds, cfg.random_state).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = compact(folded, folded.count())
        best, _ = TR.grid_search(train, candidates, label, cfg)
        params = {"n_trees": best[0]["numTrees"], "depth": best[0]["maxDepth"],
                  "min_split": 2 * best[0]["minInstancesPerNode"] - 1, "seed": cfg.random_state}
        weighted = TR.with_class_weight(train, label, "balanced" if best[0]["weight"] == "w_bal" else cfg.cost_weight, "w")
        kept = TR.recursive_elimination(weighted, candidates, label, cfg.n_features_to_select, **params)
        model = TR.fit_forest(weighted, kept, label, **params)
        oof = TR.out_of_fold(weighted, kept, label, "fold", cfg.n_folds, params)
        scoring = cfg.scoring
        metrics = cross_validated(oof, label, cfg.n_folds, cfg.decision_threshold, 1.0, scoring)
        test = TR.assemble(rows.where("is_test"), kept)
        scored = _decided(TR.probability_of_one(model.transform(test)), cfg.decision_threshold)
        scored = scored.select(label, "p1", "pred").persist(StorageLevel.MEMORY_AND_DISK)
        metrics |= test_figures(scored, label)
        ci = E.bootstrap_ci(scored.select(F.col(label).alias("label"), F.col("p1").alias("score"), "pred"),
                            n_boot=cfg.n_bootstraps, alpha=cfg.alpha, seed=cfg.random_state, with_accuracy=True,
                            with_pr_auc=False, widen_equal=0.01).first().asDict()
        metrics |= {k: v for k, v in ci.items() if k.endswith(("_lower", "_upper"))}
        scored.unpersist()
    finally:
        folded.unpersist()
        rows.unpersist()
    imp = [(r["feature"], r["importance"]) for r in TR.importance_table(spark, model, kept).collect()]
    return Trained(model, kept, metrics | {"grid_score": best[1]}, imp)


def legacy_chain(users: DataFrame, key: str, n_items: int = 11, test_size: float = 0.2, n_folds: int = 5,
                 seed: int = 42, n_trees: int = 100, depth: int = 5) -> Trained:
    """The cohort of S3, an unstratified split, a balanced forest; the final model is fitted on all rows.

    Precision and recall without a predicted or actual positive are 0."""
    label, feats = "ust", [f"set{i}" for i in range(1, n_items + 1)]
    rows = legacy_cohort(users, n_items, key).select(key, *feats, F.col("user_status").cast("int").alias(label))
    _two_classes(rows, label)
    rows = R.stratified_folds(TR.with_class_weight(rows, label, "balanced", "w"), label, key, n_folds, seed)
    rows = R.random_split(rows, key, test_size, seed).persist(StorageLevel.MEMORY_AND_DISK)
    params = {"n_trees": n_trees, "depth": depth, "seed": seed}
    try:
        train = TR.with_class_weight(rows.where(~F.col("is_test")).drop("w"), label, "balanced", "w")
        first = TR.fit_forest(train, feats, label, **params)
        scored = TR.probability_of_one(first.transform(TR.assemble(rows.where("is_test"), feats)))
        metrics = test_figures(_decided(scored, 0.5), label, 0.0)
        oof = TR.out_of_fold(rows, feats, label, "fold", n_folds, params)
        metrics |= cross_validated(oof, label, n_folds, 0.5, 0.0)
        model = TR.fit_forest(rows, feats, label, **params)
    finally:
        rows.unpersist()
    imp = [(r["feature"], r["importance"]) for r in TR.importance_table(users.sparkSession, model, feats).collect()]
    return Trained(model, feats, metrics, imp)
