"""Registered queries: name -> (spark callable, oracle SQL or None).

Keys are the SURVEY operator id plus a slug.  Every query reads the shared
tables (or views Spark derives from them) in full.  Output columns carry
the same aliases in Spark and in the oracle SQL.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import oracle as O
from quire.plans.jobs import feature_run, load_wide, survey_sources
from quire.operators.answers import accepted, parse_answers, rejected
from quire.sources.survey import labelled_load, legacy_cohort, pending_customers
from quire.spec import FK_V1, TRAINING_SLUG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _parsed(spark, sf_dir):
    src = survey_sources(spark, sf_dir)
    return labelled_load(src["users"], src["answers"], src["features"], src["statuses"],
                         TRAINING_SLUG, distinct_status=True, parse=lambda a: parse_answers(a, FK_V1))


# --------------------------------------------------------------- S1 / P1 / P2
@register("s1_labelled_load", O.with_(O.survey_ctes() + [O.cte_load()],
          "SELECT user_id, feature_id, ust, CAST(len(answer) AS INTEGER) AS answer_items FROM loaded"))
def s1_labelled_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1+P1+P2: one row per eligible (user, answer, status), with multiplicity."""
    src = survey_sources(spark, sf_dir)
    df = labelled_load(src["users"], src["answers"], src["features"], src["statuses"], TRAINING_SLUG)
    return df.select("user_id", "feature_id", "ust", F.size("answer").alias("answer_items"))


# --------------------------------------------------------------- P3 / P4 / P5
@register("p4_answer_pivot", O.with_(O.survey_ctes() + [O.cte_load(distinct_status=True), O.cte_parsed()],
          "SELECT user_id, ust, " + ", ".join(FK_V1.columns) + " FROM parsed WHERE reject_reason IS NULL"))
def p4_answer_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3+P4: validated answer arrays pivoted to 16 wide columns (last wins)."""
    return accepted(_parsed(spark, sf_dir)).select("user_id", "ust", *FK_V1.columns)


@register("p5_reject_report", O.with_(O.survey_ctes() + [O.cte_load(distinct_status=True), O.cte_parsed()],
          "SELECT user_id, reject_reason FROM parsed WHERE reject_reason IS NOT NULL"))
def p5_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: rejected answer rows with the first failing rule."""
    return rejected(_parsed(spark, sf_dir))


# ------------------------------------------------------------------------ W1
W1_COLUMNS = ["user_id", *FK_V1.engineered_columns(), "ust"]


@register("w1_feature_export", O.with_(O.feature_ctes(), "SELECT " + ", ".join(W1_COLUMNS) + " FROM engineered"))
def w1_feature_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 (S1->P3,P4,P6->P8-P13->P15-P19->F1-F6,F8): per-respondent features."""
    return feature_run(spark, sf_dir).features.select(*W1_COLUMNS)


# ------------------------------------------------------------------ statistics
from quire.operators import stats as S  # noqa: E402
from quire.sources.tables import table  # noqa: E402

LI = O.LI_COLS
LI_KEY = ["l_orderkey", "l_linenumber"]


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LI_KEY, *LI)


@register("a1_a3_column_profile", O.profile_sql())
def a1_a3_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: sample variance (zero-variance flag), population skewness,
    interpolated quartiles and IQR fences per column, one aggregation."""
    return S.profile_frame(spark, S.profile(_lineitem(spark, sf_dir), LI))


@register("a4_outlier_median", O.outlier_sql("median"))
def a4_outlier_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: outlying cells (outside the IQR fences) -> column median."""
    df = _lineitem(spark, sf_dir)
    return S.apply_outliers(df, S.profile(df, LI), "median")


@register("a5_outlier_cap", O.outlier_sql("cap"))
def a5_outlier_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: clip to the fences; columns with |skew| > 1 take the median rule."""
    df = _lineitem(spark, sf_dir)
    return S.apply_outliers(df, S.profile(df, LI), "cap")


@register("a6_outlier_remove", O.outlier_remove_sql())
def a6_outlier_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential row removal, each column refitted on what is left."""
    return S.remove_outliers(_lineitem(spark, sf_dir), LI)


def _charges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LI_KEY, *[F.expr(e).alias(c) for c, e in O.CHARGES.items()])


_CHARGES = dict(cols=list(O.CHARGES), first=(O.charges_cte(),), table="charges")


@register("a4_outlier_median_charges", O.outlier_sql("median", **_CHARGES))
def a4_outlier_median_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 on amounts that hold outliers."""
    df = _charges(spark, sf_dir)
    return S.apply_outliers(df, S.profile(df, list(O.CHARGES)), "median")


@register("a5_outlier_cap_charges", O.outlier_sql("cap", **_CHARGES))
def a5_outlier_cap_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 on amounts that hold outliers: two columns are clipped, the skewed one takes the median."""
    df = _charges(spark, sf_dir)
    return S.apply_outliers(df, S.profile(df, list(O.CHARGES)), "cap")


@register("a6_outlier_remove_charges", O.outlier_remove_sql(**_CHARGES))
def a6_outlier_remove_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on amounts that hold outliers: rows leave for two columns, the skewed one takes the median."""
    return S.remove_outliers(_charges(spark, sf_dir), list(O.CHARGES))


@register("a7_scaler_fit", O.scaler_fit_sql())
def a7_scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population std (0 -> 1) per column."""
    return S.scaler_frame(spark, S.fit_scaler(_lineitem(spark, sf_dir), LI))


@register("a8_a10_scaled", O.scaled_sql())
def a8_a10_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8+A10: standardised values rounded half-even to 3 decimals."""
    df = _lineitem(spark, sf_dir)
    return S.apply_scaler(df, S.fit_scaler(df, LI), round_digits=3)


MODEL_FEATURES = FK_V1.model_columns()


@register("a11_a13_correlations",
          O.with_(O.feature_ctes(), O.corr_sql("engineered", MODEL_FEATURES, "ust")))
def a11_a13_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson and Spearman of every model feature with the target."""
    feats = feature_run(spark, sf_dir).features
    return S.correlation_table(feats, MODEL_FEATURES, "ust")


_LABELLED_LI = ("labelled_li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax,"
                " CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)")


@register("a12_spearman_continuous", O.with_([_LABELLED_LI], O.corr_sql("labelled_li", LI, "label")))
def a12_spearman_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11-A12 on continuous columns: mid-ranks by a bucketed two-level
    prefix sum (no whole-column window)."""
    df = table(spark, sf_dir, "lineitem").select(
        *LI, (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return S.correlation_table(df, LI, "label")


@register("a14_pearson_matrix", O.pearson_matrix_sql())
def a14_pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson matrix in long form from one Gram pass."""
    return S.pearson_matrix(spark, _lineitem(spark, sf_dir), LI)


@register("a15_vif", O.vif_sql(True))
def a15_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIF with intercept = diag of the inverse correlation matrix."""
    return S.vif(spark, _lineitem(spark, sf_dir), LI, intercept=True)


@register("a16_vif_uncentred", O.vif_sql(False))
def a16_vif_uncentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIF without intercept (uncentred R^2) from the raw Gram matrix."""
    return S.vif(spark, _lineitem(spark, sf_dir), LI, intercept=False)


@register("a17_class_balance", O.with_(O.feature_ctes(), O.class_balance_sql("engineered", "ust")))
def a17_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts, percents, min/max ratio and severe flag."""
    return S.class_balance(feature_run(spark, sf_dir).features, "ust")


# ------------------------------------------------------------------ selection
from quire.operators import select as T  # noqa: E402

_CORR_BODY = O.with_(O.feature_ctes(), O.corr_sql("engineered", MODEL_FEATURES, "ust"))
N_SELECT = 10


def _corr(spark, sf_dir):
    return S.correlation_table(feature_run(spark, sf_dir).features, MODEL_FEATURES, "ust")


@register("t1_top_spearman", O.top_by_sql(_CORR_BODY, "spearman", N_SELECT))
def t1_top_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 most positive + 10 most negative Spearman features."""
    return T.top_by(_corr(spark, sf_dir), "spearman", N_SELECT)


@register("t2_top_pearson", O.top_by_sql(_CORR_BODY, "pearson", N_SELECT))
def t2_top_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same selection on Pearson."""
    return T.top_by(_corr(spark, sf_dir), "pearson", N_SELECT)


@register("t3_correlated_filter")
def t3_correlated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy |r| > 0.7 pair filter (lower variance dropped) over all
    model features; rows = kept features in column order."""
    feats = feature_run(spark, sf_dir).features
    kept = T.filter_correlated(spark, feats, MODEL_FEATURES)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(kept)], "feature STRING, position INT")


@register("t4_uncorrelated_top")
def t4_uncorrelated_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: T1 candidates, then the T3 filter, then the first 10."""
    feats = feature_run(spark, sf_dir).features
    corr = S.correlation_table(feats, MODEL_FEATURES, "ust")
    kept = T.select_uncorrelated_top(spark, feats, corr, N_SELECT)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(kept)], "feature STRING, position INT")


@register("t10_chart_data", O.chart_sql(_CORR_BODY))
def t10_chart_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart rows, top 10 positive and bottom 10 negative Pearson."""
    return T.chart_data(_corr(spark, sf_dir))


@register("t11_disagreement", O.disagreement_sql(_CORR_BODY))
def t11_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with |pearson - spearman| > 0.1."""
    return T.disagreement(_corr(spark, sf_dir))


# ------------------------------------------------------------------ screening
from quire.operators.answers import wide_to_groups  # noqa: E402
from quire.operators.prepare import recode  # noqa: E402
from quire.operators.screen import screen  # noqa: E402
from quire.sources import fixtures as FX  # noqa: E402


def _respondents_recoded(spark, sf_dir):
    w = FX.answers_wide(spark, sf_dir).select("user_id", *FK_V1.columns)
    return recode(w, FK_V1)


_SCREEN_GROUPS = {"fht": [c for c in FK_V1.columns if c.startswith("fht")],
                  "kmsi": [c for c in FK_V1.columns if c.startswith("kmsi")]}
_RECODED_CTE = ("recoded_resp AS (SELECT user_id, " + ", ".join(O._recode_expr(c) for c in FK_V1.columns)
                + " FROM answers_wide WHERE " + " AND ".join(f"{c} IN (1, 2, 3)" for c in FK_V1.columns) + ")")


@register("c1_screening", O.with_([O.cte_answers_wide(), _RECODED_CTE],
          "SELECT user_id, s.screening_passed, s.screening_msg FROM recoded_resp, LATERAL "
          + O.screen_sql(_SCREEN_GROUPS) + " s"))
def c1_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 on recoded answers of every respondent (P15 -> P29 -> C1)."""
    r = _respondents_recoded(spark, sf_dir)
    s = screen(wide_to_groups(FK_V1), FK_V1.stems)
    return r.select("user_id", s.alias("s")).select("user_id", "s.screening_passed", "s.screening_msg")


# ------------------------------------------------------------------ evaluation
from quire.operators import evaluate as E  # noqa: E402


def _scores(spark, sf_dir, threshold: float = 0.5):
    s = FX.lineitem_scores(spark, sf_dir)
    return s.withColumn("pred", E.decide(F.col("score"), threshold))


@register("e1_e3_metrics", O.counts_sql(1.0))
def e1_e3_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1+E3: p >= 0.5 decisions; accuracy, precision, recall, F1 (zero division 1)."""
    return E.count_metrics(_scores(spark, sf_dir), zero_division=1.0)


@register("e2_confusion", O.confusion_sql())
def e2_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix cells."""
    return E.confusion(_scores(spark, sf_dir))


@register("e4_roc_auc", O.roc_auc_sql())
def e4_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC (ties half) from per-score cells."""
    return E.roc_auc(E.score_cells(_scores(spark, sf_dir)))


@register("e5_pr_auc", O.pr_auc_sql())
def e5_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: trapezoid PR AUC with the (recall 0, precision 1) end point."""
    return E.pr_auc(E.score_cells(_scores(spark, sf_dir)))


@register("e7_accuracy_ci", O.accuracy_ci_sql(E.z_value(0.05)))
def e7_accuracy_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal-approximation accuracy CI (alpha 0.05)."""
    s = _scores(spark, sf_dir)
    a = s.agg(F.avg(F.when(F.col("label") == F.col("pred"), 1.0).otherwise(0.0)).alias("accuracy"),
              F.count(F.lit(1)).alias("n"))
    return a.select("accuracy", "n", *E.accuracy_ci(F.col("accuracy"), F.col("n")))


@register("e8_bootstrap_ci")
def e8_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 Poisson-bootstrap replicates over (score, label, pred) cells;
    2.5/97.5 percentile bounds of precision, recall, F1, ROC AUC, PR AUC."""
    return E.bootstrap_ci(_scores(spark, sf_dir), n_boot=500)


@register("e9_bootstrap_ci_wide")
def e9_bootstrap_ci_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 replicates, accuracy included, equal bounds widened by 0.01."""
    return E.bootstrap_ci(_scores(spark, sf_dir), n_boot=1000, with_accuracy=True, with_pr_auc=False,
                          widen_equal=0.01)


@register("e10_class_report", O.class_report_sql())
def e10_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision / recall / F1 / support."""
    return E.per_class_report(_scores(spark, sf_dir))


# ------------------------------------------------------------------ resampling
from quire.operators import resample as R  # noqa: E402

_SCORES_SQL = ("SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(l_returnflag = 'R' AS INTEGER) AS label"
               " FROM lineitem")
_EMB_SQL = "SELECT vec_id, CAST(label = 0 AS INTEGER) AS label FROM embeddings"


def _labelled_rows(spark, sf_dir):
    return FX.lineitem_scores(spark, sf_dir).select("row_id", "label")


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", (F.col("label") == 0).cast("int").alias("label"), "embedding")


@register("r1_stratified_split", O.split_counts_sql(_SCORES_SQL))
def r1_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 20 % test split (seed 42); rows per (class, side)."""
    s = R.stratified_split(_labelled_rows(spark, sf_dir), "label", "row_id", 0.2, 42)
    return s.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("r2_stratified_folds", O.fold_counts_sql(_SCORES_SQL))
def r2_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: stratified 5-fold assignment; rows per (class, fold)."""
    s = R.stratified_folds(_labelled_rows(spark, sf_dir), "label", "row_id", 5, 42)
    return s.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("r3_random_oversample", O.oversample_counts_sql(_SCORES_SQL))
def r3_random_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random over-sampling to the majority count; rows per (class, synthetic)."""
    s = R.oversample_random(_labelled_rows(spark, sf_dir), "label", "row_id", 42)
    return s.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("r4_undersample", O.undersample_counts_sql(_SCORES_SQL))
def r4_undersample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random under-sampling to the minority count; rows per class."""
    s = R.undersample(_labelled_rows(spark, sf_dir), "label", "row_id", 42)
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("r5_smote", O.oversample_counts_sql(_EMB_SQL))
def r5_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE (k=3, exact kNN) on embeddings, minority = label 0; counts."""
    s = R.smote_family(_embeddings(spark, sf_dir), "label", "vec_id", "embedding", "smote")
    return s.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("r6_adasyn")
def r6_adasyn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ADASYN - synthetic rows in proportion to majority neighbours."""
    return R.smote_family(_embeddings(spark, sf_dir), "label", "vec_id", "embedding", "adasyn")


@register("r7_smotenc")
def r7_smotenc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTENC - positions 0 and 1 treated as categorical (neighbour mode)."""
    df = _embeddings(spark, sf_dir).withColumn(
        "embedding", F.transform("embedding", lambda v, i: F.when(i < 2, F.round(v * 4)).otherwise(v)))
    return R.smote_family(df, "label", "vec_id", "embedding", "smotenc", categorical_idx=(0, 1))


@register("r8_borderline_smote")
def r8_borderline_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BorderlineSMOTE-1 - seeds are minority rows in danger (m=10)."""
    return R.smote_family(_embeddings(spark, sf_dir), "label", "vec_id", "embedding", "borderline")


# ------------------------------------------------------------------ models
from quire.operators import train as TR  # noqa: E402
from quire.operators import publish as PB  # noqa: E402
from quire.operators import registry as RG  # noqa: E402
from quire.plans import jobs as J  # noqa: E402
from quire.plans import leakfree as LF  # noqa: E402
from quire.plans import trainers as W4  # noqa: E402
from quire.session import cut_lineage, ensure_checkpoint_dir  # noqa: E402

# Grid of the registered training queries: the reference's grid shape
# (trees x depth x min split x two weightings) at a size a query can run.
QUERY_CFG = dict(n_estimators=[30], max_depth=[5, 10], min_samples_split=[2], n_folds=5,
                 n_bootstraps=500)


def _prepared(spark, sf_dir):
    prep, corr, chosen = J.preprocess_and_select(feature_run(spark, sf_dir).features, FK_V1, N_SELECT)
    return prep, chosen


def _weighted(prep):
    return TR.with_class_weight(prep.frame, "ust", "balanced", "w")


@register("w2_preprocess")
def w2_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20 -> outliers (A4) -> scaler (A7/A8) -> zero-variance drop
    -> half-even rounding (A10) on the W1 frame."""
    return J.preprocess(feature_run(spark, sf_dir).features, FK_V1).frame


@register("m1_forest_importance")
def m1_forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + T9: balanced random forest on the selected features; importances."""
    prep, chosen = _prepared(spark, sf_dir)
    m = TR.fit_forest(_weighted(prep), chosen, "ust", n_trees=50, depth=5)
    return TR.importance_table(spark, m, chosen)


@register("m2_logistic_coefficients")
def m2_logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 (+T9 |coef|): balanced L2 logistic regression coefficients."""
    prep, chosen = _prepared(spark, sf_dir)
    df = _weighted(prep)
    m = TR.logistic("ust", "w", n_rows=df.count()).fit(TR.assemble(df, chosen))
    coef = m.coefficients.toArray()
    rows = sorted([(f, float(c), abs(float(c))) for f, c in zip(chosen, coef)], key=lambda t: (-t[2], t[0]))
    return spark.createDataFrame(rows, "feature STRING, coefficient DOUBLE, importance DOUBLE")


@register("m3_grid_search")
def m3_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: grid search with stratified folds, scored by F1 of class 1."""
    prep, chosen = _prepared(spark, sf_dir)
    cfg = TR.ModelConfig(**QUERY_CFG)
    folds = R.stratified_folds(prep.frame, "ust", "user_id", cfg.n_folds, cfg.random_state)
    with TR.held(folds) as rows:
        best, grid = TR.grid_search(rows, chosen, "ust", cfg)
    rows = [(int(p["numTrees"]), int(p["maxDepth"]), int(p["minInstancesPerNode"]), p["weight"], s,
             p == best[0]) for p, s in grid]
    return spark.createDataFrame(rows, "num_trees INT, max_depth INT, min_instances_per_node INT, "
                                       "weighting STRING, f1 DOUBLE, best BOOLEAN")


@register("m4_oof_predictions")
def m4_oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: out-of-fold p(class 1) for every training row (3 folds)."""
    prep, chosen = _prepared(spark, sf_dir)
    df = R.stratified_folds(_weighted(prep), "ust", "user_id", 3, 42)
    oof = TR.out_of_fold(df, chosen, "ust", "fold", 3, {"n_trees": 30, "depth": 5})
    return oof.select("user_id", "fold", "ust", "p1")


@register("t5_importance_select")
def t5_importance_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: features with importance >= mean importance (at most 10)."""
    prep, _ = _prepared(spark, sf_dir)
    m = TR.fit_forest(_weighted(prep), prep.features, "ust", n_trees=50, depth=5)
    keep = TR.select_by_importance(spark, m, prep.features, N_SELECT)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(keep)], "feature STRING, position INT")


@register("t6_recursive_elimination")
def t6_recursive_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive elimination from the T1 candidates to max(n, p/2)."""
    prep, chosen = _prepared(spark, sf_dir)
    keep = TR.recursive_elimination(_weighted(prep), chosen, "ust", 5, n_trees=30, depth=5)
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(keep)], "feature STRING, position INT")


@register("t7_backward_elimination")
def t7_backward_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic backward elimination while test AUC does not fall."""
    prep, chosen = _prepared(spark, sf_dir)
    s = R.stratified_split(_weighted(prep), "ust", "user_id", 0.2, 42)
    tr, te = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    keep, auc = TR.backward_elimination(tr, te, chosen, "ust", n_rows=tr.count())
    return spark.createDataFrame([(f, i + 1, float(auc)) for i, f in enumerate(keep)],
                                 "feature STRING, position INT, test_roc_auc DOUBLE")


@register("t8_vif_replacement")
def t8_vif_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VIF-driven replacement (max VIF 1.5) from one Gram pass."""
    prep, chosen = _prepared(spark, sf_dir)
    df = _weighted(prep)
    m = TR.fit_forest(df, chosen, "ust", n_trees=30, depth=5)
    start = TR.select_by_importance(spark, m, chosen, N_SELECT)
    cur, removed, added = TR.vif_replacement(df, "ust", start, chosen, 1.5, n_trees=30, depth=5)
    rows = [(f, "kept") for f in cur] + [(f, "removed") for f in removed if f not in cur]
    return spark.createDataFrame(rows, "feature STRING, status STRING")


@register("w3_train_evaluate")
def w3_train_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, borderline over-sampling, grid search, importance and VIF
    selection, final fit, CV / test metrics with bootstrap CIs (one row)."""
    prep, chosen = _prepared(spark, sf_dir)
    res = J.train_and_evaluate(prep.frame, chosen, TR.ModelConfig(**QUERY_CFG))
    m = res["metrics"]
    keys = sorted(m)
    row = tuple(float(m[k]) for k in keys) + (",".join(res["features"]),)
    return spark.createDataFrame([row], ", ".join(f"{k} DOUBLE" for k in keys) + ", final_features STRING")


@register("w3_train_leak_free")
def w3_train_leak_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 with every fit inside the folds: outliers, scaler, feature choice and over-sampling see the
    other folds' original rows only (one row of figures)."""
    res = LF.train_leak_free(feature_run(spark, sf_dir).features, TR.ModelConfig(**QUERY_CFG), n_select=N_SELECT)
    m = res["metrics"]
    keys = sorted(m)
    row = tuple(float(m[k]) for k in keys) + (",".join(res["features"]),)
    return spark.createDataFrame([row], ", ".join(f"{k} DOUBLE" for k in keys) + ", final_features STRING")


def _scoring_model(spark, sf_dir):
    prep, chosen = _prepared(spark, sf_dir)
    model = TR.fit_forest(_weighted(prep), chosen, "ust", n_trees=50, depth=5)
    return model, prep.scaler, chosen


@register("w5_batch_score")
def w5_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 + C3-C8: route, select answers, validate, recode, screen,
    engineer, scale, predict, approve - one output row per request."""
    model, scaler, chosen = _scoring_model(spark, sf_dir)
    return J.batch_score(FX.payloads(spark, sf_dir), model, scaler, chosen, FK_V1)


def _published(spark, sf_dir):
    """A registry whose current version is the scoring model of this input; returns its folder."""
    model, scaler, chosen = _scoring_model(spark, sf_dir)
    root = _artifact_dir(spark, "published")
    importances = list(zip(chosen, model.featureImportances.toArray().tolist()))
    folder = PB.prepare(spark, root, model, scaler, importances, {"cv_f1": 0.5, "cv_score_std": 0.05}, "20250101_000000")
    PB.promote(spark, root, folder, None)
    return root


@register("w5_registry_score")
def w5_registry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 with C11 and C14: publish the model and scaler, load them by the registry with their checksums, score."""
    return J.score_from_registry(FX.payloads(spark, sf_dir), _published(spark, sf_dir), FK_V1)


@register("c7_three_group_features")
def c7_three_group_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-group survey variant (fht + set + kmsi) up to features
    and screening; 'set' answers are carried, not recoded or grouped."""
    from quire.spec import FSK_V2
    req = FX.payloads(spark, sf_dir, with_set=True)
    return J.payload_features(req, FSK_V2).drop("application_label")


# ------------------------------------------------------------ registry, sinks
import uuid  # noqa: E402


def _artifact_dir(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(ensure_checkpoint_dir(spark), "quire-artifacts", f"{name}-{uuid.uuid4().hex}")


def _two_versions(spark, sf_dir):
    """Train two quick model versions on the W1 frame, save them with MLlib
    and record both in a registry table (S9); returns (registry, root, the frame's columns)."""
    feats = feature_run(spark, sf_dir).features
    df = TR.with_class_weight(feats, "ust", "balanced", "w")
    chosen = list(MODEL_FEATURES)
    root = _artifact_dir(spark, "registry")
    reg_path = os.path.join(root, "registry")
    s = R.stratified_split(df, "ust", "user_id", 0.2, 42)
    folds = cut_lineage(R.stratified_folds(s.where(~F.col("is_test")).drop("is_test"), "ust", "user_id", 5, 42))
    # Every fit and figure below reads these few columns only; both versions share them.
    s = s.select(*chosen, "ust", "w", "is_test").persist(StorageLevel.MEMORY_AND_DISK)
    tr, te = s.where(~F.col("is_test")), s.where(F.col("is_test"))

    def version(v, trees, ts, rows):
        m = TR.fit_forest(tr, chosen, "ust", n_trees=trees, depth=4)
        mpath = os.path.join(root, "models", f"model_v{v}")
        m.write().overwrite().save(mpath)
        pt = TR.probability_of_one(m.transform(TR.assemble(te, chosen))).withColumn(
            "pred", E.decide(F.col("p1"), 0.5))
        cm = E.count_metrics(pt, "ust", "pred", 1.0).first()
        auc = E.roc_auc(E.score_cells(pt, "ust", "p1")).first()["roc_auc"]
        oof = TR.fold_predictions(rows, "ust", "fold", 5, {"n_trees": trees, "depth": 4},
                                  parallelism=TR.PARALLEL // 2).withColumn("pred", E.decide(F.col("p1"), 0.5))
        cvm = E.count_metrics(oof, "ust", "pred", 1.0).first()
        two = oof.groupBy("fold").agg((F.count_distinct("ust") == 2).alias("two_classes"))
        cvs = E.cv_summary(E.count_metrics(oof, "ust", "pred", 1.0, by=["fold"]).join(two, "fold"), "f1").first()
        metrics = {"test_accuracy": cm["accuracy"], "test_precision": cm["precision"],
                   "test_recall": cm["recall"], "test_f1": cm["f1"], "test_roc_auc": auc,
                   "cv_f1": cvm["f1"], "cv_score_std": cvs["cv_score_std"]}
        imp = sorted(zip(chosen, [float(x) for x in m.featureImportances.toArray()]), key=lambda t: -t[1])
        return RG.registry_row(spark, metrics, imp, {"model_path": mpath}, ts, versions={"pyspark": spark.version})

    try:
        with TR.held(TR.assemble(folds, chosen).select("fold", "ust", "w", "features")) as rows:
            for row in TR.side_by_side(lambda x: version(*x, rows), [(1, 10, "20250101_000000"), (2, 20, "20250102_000000")], 2):
                RG.append(row, reg_path)
    finally:
        s.unpersist()
    return spark.read.parquet(reg_path), root, feats.columns


@register("s9_s10_registry_csv_roundtrip")
def s9_s10_registry_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + S10: registry rows written as CSV (JSON-encoded lists/maps) and
    read back with JSON decoding and default back-fill."""
    reg, root, _ = _two_versions(spark, sf_dir)
    path = os.path.join(root, "registry_csv")
    RG.to_csv_view(reg).coalesce(1).write.mode("overwrite").option("header", True).option(
        "quote", '"').option("escape", '"').csv(path)
    back = RG.read_csv_registry(spark, path)
    return back.select("timestamp", "model_path", "test_f1", "final_features", "package_versions",
                       F.size("final_features").alias("n_features"))


@register("c9_c10_latest_and_gate")
def c9_c10_latest_and_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 latest registry row by timestamp + C10 promotion gate of a
    candidate scoring 0.01 above it with CV std 0.05."""
    reg, _, _ = _two_versions(spark, sf_dir)
    last = RG.latest(reg)
    cur = last.select("cv_f1").first()["cv_f1"]
    gate = RG.promotion_gate(last, cur + 0.01, 0.05, "cv_f1")
    return last.select("timestamp", "model_path", "cv_f1", F.lit(gate).alias("promote_candidate"))


@register("c11_c14_artifact_manifest")
def c11_c14_artifact_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the models' files verified against the checksums taken when they were saved, after one file of
    the older model was changed; C14: latest registry paths resolved against the files."""
    reg, root, _ = _two_versions(spark, sf_dir)
    saved = RG.manifest(spark, os.path.join(root, "models"))
    # A few files for each model.
    expected = spark.createDataFrame(saved.select("path", "sha256").collect(), "path string, sha256 string")
    first = expected.where(F.col("path").contains("model_v1")).agg(F.min("path")).first()[0]
    PB.rewrite(spark, first, spark.read.format("binaryFile").load(first).first()["content"] + b" ")
    man = RG.manifest(spark, os.path.join(root, "models"))
    ver = RG.verify(man, expected)
    # C14: the latest row's model path is a folder (MLlib's layout).
    resolved = RG.resolve_artifacts(RG.latest(reg), man).select(
        (F.col("model_path") != "").alias("model_found"), (F.length("model_checksum") == 64).alias("checksum_ok"))
    return ver.groupBy("status").agg(F.count(F.lit(1)).alias("files")).join(
        resolved.withColumn("status", F.lit("ok")), "status", "left")


@register("s5_s6_s7_sinks")
def s5_s6_s7_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 snapshot (parquet + CSV), S6 JSON records, S7 append of two
    prediction batches, S8/J5 next pending set; returns the row counts."""
    feats = feature_run(spark, sf_dir).features
    root = _artifact_dir(spark, "sinks")
    RG.write_snapshot(feats, os.path.join(root, "snapshot"))
    RG.write_snapshot(feats, os.path.join(root, "snapshot_csv"), fmt="csv")
    RG.write_json_records(feats, os.path.join(root, "records"))
    preds = feats.select(F.col("user_id").alias("customer_id"), F.col("ust").alias("predicted_ust"),
                         (F.col("loan_score_avg") / 3.0).alias("probability_ust1"))
    ppath = os.path.join(root, "predictions")
    RG.append(preds.where(F.col("customer_id") % 2 == 0), ppath)
    RG.append(preds.where(F.col("customer_id") % 2 == 1), ppath)
    customers = FX.users(spark, sf_dir).select(F.col("user_id").alias("customer_id"))
    pend = RG.pending(customers, spark.read.parquet(ppath))
    counts = [("snapshot", spark.read.parquet(os.path.join(root, "snapshot")).count()),
              ("snapshot_csv", spark.read.option("header", True).csv(os.path.join(root, "snapshot_csv")).count()),
              ("records", spark.read.json(os.path.join(root, "records")).count()),
              ("predictions", spark.read.parquet(ppath).count()), ("pending", pend.count())]
    return spark.createDataFrame(counts, "sink STRING, n BIGINT")


@register("j4_j5_membership", O.with_(
    [O.cte_users(), O.cte_statuses()],
    "SELECT user_id, true AS has_status FROM users u WHERE EXISTS (SELECT 1 FROM loan_summary_statuses l"
    " WHERE l.user_id = u.user_id AND l.loan_status <> 'pending')"
    " UNION ALL SELECT user_id, false AS has_status FROM users u WHERE NOT EXISTS (SELECT 1 FROM"
    " loan_summary_statuses l WHERE l.user_id = u.user_id AND l.loan_status <> 'pending')"))
def j4_j5_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 semi-join membership and J5 anti-join: customers with / without
    an eligible loan status."""
    users = FX.users(spark, sf_dir)
    st = FX.loan_summary_statuses(spark, sf_dir).where(F.col("loan_status") != "pending")
    return (RG.members(users, st, "user_id").select("user_id", F.lit(True).alias("has_status"))
            .unionByName(users.join(st.select("user_id"), "user_id", "left_anti")
                         .select("user_id", F.lit(False).alias("has_status"))))


@register("c13_streaming_score")
def c13_streaming_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request files scored by a Structured Streaming query (three
    micro-batches, foreachBatch, anti-join dedup, batch partitions)."""
    from quire.streaming.scoring import start_scoring_stream
    model, scaler, chosen = _scoring_model(spark, sf_dir)
    root = _artifact_dir(spark, "stream")
    src = os.path.join(root, "requests")
    req = FX.payloads(spark, sf_dir)
    for part in range(3):
        req.where(F.pmod(F.col("resp_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(src)
    q = start_scoring_stream(spark, src, req.schema, os.path.join(root, "scored"),
                             os.path.join(root, "checkpoint"), model, scaler, chosen)
    q.awaitTermination()
    return spark.read.parquet(os.path.join(root, "scored"))


# ------------------------------------------------------------- prepare ops
from quire.operators import prepare as PR  # noqa: E402
from quire.operators.answers import group_answers, select_answers  # noqa: E402
from quire.operators.features import categorical_rollup  # noqa: E402
from quire.operators.score import route  # noqa: E402


def _impute_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey",
                    F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"),
                    F.when(k % 11 == 0, F.lit("n/a")).when(k % 13 == 0, F.lit(None))
                    .otherwise(F.col("o_totalprice").cast("bigint").cast("string")).alias("price_text"))


@register("p9_p13_imputation", O.impute_sql())
def p9_p13_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9/P11 mode imputation (ties -> smallest), P12 numeric coercion
    (unparsable -> NULL), P13 median imputation."""
    df = PR.coerce_numeric(_impute_source(spark, sf_dir).withColumnRenamed("price_text", "price"), ["price"])
    fills = {"status": PR.fit_mode(df, "status"), **PR.fit_impute(df, ["price"], "median")}
    return PR.apply_fill(df, fills)


@register("p17_onehot_encode")
def p17_onehot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17 one-hot of customer.c_mktsegment (sorted levels, NULL ->
    'missing') followed by F7 rollup (c_mktsegment_group_sum / _count)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    vocab = PR.fit_categories(c, ["c_mktsegment"])
    enc = PR.apply_onehot(c, vocab)
    return categorical_rollup(enc, FK_V1, categorical=["c_mktsegment"])


@register("p18_label_encode", O.label_encode_sql())
def p18_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label encoding of part.p_brand, 0..k-1 in sorted order."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return PR.apply_labels(p, {"p_brand": PR.fit_labels(p, "p_brand")})


@register("p22_quality_report",
          O.quality_sql(O.feature_ctes(), "engineered", W1_COLUMNS, "ust", "engineered"))
def p22_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-quality gate rules on the W1 frame (one aggregation)."""
    return PR.quality_report(feature_run(spark, sf_dir).features.select(*W1_COLUMNS), "engineered",
                             target="ust")


@register("p25_answer_select", O.select_answers_sql())
def p25_answer_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: choices of (fht, v1) and (kmsi, v1) ordered by int(item)."""
    req = FX.payloads(spark, sf_dir)
    m = select_answers(F.col("answers"), [{"group": "fht", "version": "1"}, {"group": "kmsi", "version": "1"}])
    return req.select("resp_id", *[F.array_join(F.try_element_at(m, F.lit(g)), ",").alias(g)
                                   for g in ("fht", "kmsi")])


@register("p26_dynamic_grouping", O.group_answers_sql())
def p26_dynamic_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group answers by any non-empty group, items sorted numerically."""
    g = group_answers(FX.payloads(spark, sf_dir))
    return g.select("resp_id", "group", F.array_join("choices", ",").alias("choices"))


@register("c8_route", O.route_sql())
def c8_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing of requests by application label; unknown -> reason."""
    return route(FX.payloads(spark, sf_dir).drop("answers"))


@register("p23_importance_validation")
def p23_importance_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance rows of the registry checked against the feature
    catalogue of the W1 frame (invalid values, unknown features)."""
    reg, _, columns = _two_versions(spark, sf_dir)
    rows = reg.select("timestamp", F.explode("final_features").alias("f")).select(
        "timestamp", "f.feature", "f.importance")
    rows = rows.unionByName(spark.createDataFrame([("manual", "not_a_feature", 0.1), ("manual", "kmsi1", -1.0)],
                                                  "timestamp string, feature string, importance double"))
    cat = spark.createDataFrame([(c,) for c in columns], "feature string")
    return T.importance_violations(rows, cat)


@register("e6_cv_scores")
def e6_cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall per stratified fold (5 folds) of the p >= 0.5 rule, then
    mean and population std over folds holding both classes."""
    s = R.stratified_folds(_scores(spark, sf_dir), "label", "row_id", 5, 42)
    per = E.count_metrics(s, "label", "pred", 1.0, by=["fold"])
    two = s.groupBy("fold").agg((F.count_distinct("label") == 2).alias("two_classes"))
    return E.cv_summary(per.join(two, "fold"), "recall")


@register("w4_logistic_path")
def w4_logistic_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 (logistic trainer): T2 top Pearson -> R1 split -> T7 backward
    elimination -> M2 balanced logistic fit -> E10 per-class test report."""
    res = _logistic_chain(spark, sf_dir, cross_validate=False)
    return res.report.withColumn("features", F.lit(",".join(res.features)))


def _logistic_chain(spark, sf_dir, **kw):
    prep = J.preprocess(feature_run(spark, sf_dir).features, FK_V1)
    corr = S.correlation_table(prep.frame, prep.features, "ust")
    cand = [r["feature"] for r in T.top_by(corr, "pearson", N_SELECT).orderBy("position").collect()]
    return W4.logistic_chain(prep.frame, cand, **kw)


@register("t7_cv_figures")
def t7_cv_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test and cross-validated figures of the set that backward elimination keeps."""
    return W4.figures_table(spark, _logistic_chain(spark, sf_dir).metrics)


@register("w4_forest_chain")
def w4_forest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 (alternative trainer): T4 -> R1 -> R3 -> M3 -> T6 -> E1-E6, E9."""
    prep = J.preprocess(feature_run(spark, sf_dir).features, FK_V1)
    corr = S.correlation_table(prep.frame, prep.features, "ust")
    cand = T.select_uncorrelated_top(spark, prep.frame, corr, N_SELECT)
    cfg = TR.ModelConfig(**QUERY_CFG | {"n_bootstraps": 1000, "oversampling_method": "random", "scoring": "roc_auc"})
    return W4.figures_table(spark, W4.forest_chain(prep.frame, cand, cfg).metrics)


@register("w4_legacy_chain")
def w4_legacy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 (legacy trainer): S3 -> R1 -> M1 -> E3, E4, E6 -> T9."""
    res = W4.legacy_chain(FX.legacy_users(spark, sf_dir), "user_id")
    return W4.figures_table(spark, res.metrics | {f"importance_{f}": v for f, v in res.importances})


@register("s3_legacy_cohort", O.legacy_cohort_sql())
def s3_legacy_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: settled users and recovered payers with their eleven answers."""
    return legacy_cohort(FX.legacy_users(spark, sf_dir), key="user_id")


@register("s4_pending_customers", O.pending_customers_sql())
def s4_pending_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers not scored yet."""
    return pending_customers(FX.new_customers(spark, sf_dir))
