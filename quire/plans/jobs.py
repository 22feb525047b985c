"""Composed jobs (W1-W5): chains of the operators exposed as one callable."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.answers import accepted, fill_int, parse_answers, rejected
from quire.operators.features import apply_nonfinite_fill, engineer, fit_nonfinite_fill
from quire.operators.prepare import (DataQualityError, apply_fill, coerce_numeric, dedup_exact, enforce, fit_impute,
                                     fit_mode, recode, target_domain)
from quire.session import compact, cut_lineage, stored
from quire.sources import fixtures
from quire.sources.survey import labelled_load
from quire.spec import FK_V1, TRAINING_SLUG, SurveySpec


@dataclass
class FeatureRun:
    """Result of W1: the engineered frame plus its side outputs and fits."""
    features: DataFrame
    rejects: DataFrame
    reports: list = field(default_factory=list)
    fits: dict = field(default_factory=dict)


def survey_sources(spark: SparkSession, sf_dir: str) -> dict:
    return {"users": fixtures.users(spark, sf_dir), "answers": fixtures.answers(spark, sf_dir),
            "features": fixtures.features(spark),
            "statuses": fixtures.loan_summary_statuses(spark, sf_dir)}


def load_wide(src: dict, spec: SurveySpec = FK_V1, slug: str = TRAINING_SLUG,
              distinct_status: bool = True) -> tuple[DataFrame, DataFrame]:
    """S1 -> P3/P4/P5 -> P6: wide rows (user_id, 16 ints, ust) and rejects."""
    parsed = labelled_load(src["users"], src["answers"], src["features"], src["statuses"], slug,
                           distinct_status=distinct_status, parse=lambda a: parse_answers(a, spec))
    wide = fill_int(accepted(parsed).select("user_id", *spec.columns, "ust"), spec.columns)
    return wide, rejected(parsed)


def clean(wide: DataFrame, spec: SurveySpec = FK_V1, method: str = "median",
          fits: dict | None = None, cached: list | None = None, gate=None) -> DataFrame:
    """P8 -> P9 -> P10 -> P12 -> P13 (data_cleaning).

    The frame that is kept in memory is appended to ``cached`` for the caller to release;
    ``gate`` is called with it before anything is fitted."""
    fits = {} if fits is None else fits
    # The de-duplicated frame feeds several small fits and the final plan:
    # keep it (memory+disk; lost blocks are recomputed from lineage).
    df = dedup_exact(wide).persist(StorageLevel.MEMORY_AND_DISK)
    if cached is not None:
        cached.append(df)
    if gate is not None:
        gate(df)
    t = spec.target
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(t).isNull()).alias("nulls")).first()
    fits["rows"] = seen["rows"]
    if seen["nulls"]:
        fits["target_mode"] = fit_mode(df, t)
        df = apply_fill(df, {t: fits["target_mode"]})
    df = target_domain(df, t)
    df = coerce_numeric(df, spec.columns)
    fits["impute"] = fit_impute(df, spec.columns, method)
    return apply_fill(df, fits["impute"])


def transform(df: DataFrame, spec: SurveySpec = FK_V1, fits: dict | None = None) -> DataFrame:
    """P15 -> P16 -> P19 (data_transforming; the id is kept as a key)."""
    fits = {} if fits is None else fits
    out = recode(df, spec)
    fits["post_recode_impute"] = fit_impute(out, [c for c in spec.recode if c in out.columns])
    out = apply_fill(out, fits["post_recode_impute"])
    return target_domain(out, spec.target)


def feature_run(spark: SparkSession, sf_dir: str, spec: SurveySpec = FK_V1,
                slug: str = TRAINING_SLUG, method: str = "median") -> FeatureRun:
    """Load -> parse -> clean -> transform -> engineer (F1-F6, F8), with
    a P22 gate after each step: a frame that fails it raises ``DataQualityError``
    and no later step runs.  A single class of the target is only reported here,
    the trainers refuse it.

    The gates read the de-duplicated frame that is kept in memory (it has rows and values just if
    the loaded one has) and the checkpointed result, so none of them reads the sources again."""
    fits: dict = {}
    reports: list = []
    cached: list = []

    def gate(df: DataFrame, name: str, **rules) -> None:
        reports.append(enforce(df, name, warn=("target_two_classes",), target=spec.target, **rules))

    wide, rejects = load_wide(survey_sources(spark, sf_dir), spec, slug)
    try:
        cleaned = clean(wide, spec, method, fits, cached, gate=lambda df: gate(df, "raw"))
        gate(cleaned, "cleaned")
        transformed = transform(cleaned, spec, fits)
        gate(transformed, "transformed")
        # Stage boundary: the engineered frame is written to the shared checkpoint folder
        # (survives executor loss, keeps later plans small) before anything is fitted on it,
        # so the features are computed once.
        eng = cut_lineage(compact(engineer(transformed, spec), fits["rows"]))
        fits["nonfinite"] = fit_nonfinite_fill(eng, exclude=(spec.target, spec.key))
        if fits["nonfinite"]:
            eng = cut_lineage(apply_nonfinite_fill(eng, fits["nonfinite"]))
    finally:
        for frame in cached:
            frame.unpersist()
    gate(eng, "engineered", required=spec.engineered_columns())
    return FeatureRun(eng, rejects, reports, fits)


# ---------------------------------------------------------------------- W2
from quire.operators import evaluate as E  # noqa: E402
from quire.operators import publish as PB  # noqa: E402
from quire.operators import resample as R  # noqa: E402
from quire.operators import stats as S  # noqa: E402
from quire.operators import train as TR  # noqa: E402
from quire.operators.prepare import prune_suffixes  # noqa: E402
from quire.operators.select import top_by  # noqa: E402


@dataclass
class Prepared:
    frame: DataFrame          # scaled, rounded model frame (key, features, target)
    scaler: dict              # A7 fit (mean, scale) per feature
    outliers: dict            # A3/A4 fit per feature
    dropped: list             # A9 zero-variance columns removed after scaling
    features: list            # model feature columns


def preprocess(features: DataFrame, spec: SurveySpec = FK_V1, method: str = "median",
               drop_suffixes=("_sum", "_count", "_var")) -> Prepared:
    """W2 first half: P20 -> A4/A5 (IQR fences, skew rule) -> A7 -> A8 -> A9 -> A10."""
    df = prune_suffixes(features, drop_suffixes)
    feats = [c for c in df.columns if c not in (spec.key, spec.target)]
    prof = S.profile(df, feats)
    treated = (S.remove_outliers(df, feats) if method == "remove" else S.apply_outliers(df, prof, method)).persist(
        StorageLevel.MEMORY_AND_DISK)
    scaler = S.fit_scaler(treated, feats)
    scaled = S.apply_scaler(treated, scaler)
    zero = S.zero_variance(scaled, feats)
    kept = [f for f in feats if f not in zero]
    out = S.apply_scaler(treated, {f: scaler[f] for f in kept}, round_digits=3).select(
        spec.key, *kept, spec.target)
    return Prepared(out, scaler, prof, zero, kept)


def preprocess_and_select(features: DataFrame, spec: SurveySpec = FK_V1, n: int = 10):
    """Preprocess, gate (P22), correlate (A11-A13), select top Spearman.

    ``DataQualityError`` if the prepared frame fails the gate or no feature is selected."""
    prep = preprocess(features, spec)
    enforce(prep.frame, "preprocessed", target=spec.target)
    corr = S.correlation_table(prep.frame, prep.features, spec.target)
    chosen = [r["feature"] for r in top_by(corr, "spearman", n).orderBy("position").collect()]
    if not chosen:
        raise DataQualityError("no feature was selected")
    return prep, corr, chosen


# ---------------------------------------------------------------------- W3
def oversample_frame(df: DataFrame, features: list[str], label: str, key: str, method: str,
                     seed: int = 42, categorical: list[str] | None = None) -> DataFrame:
    """R3/R5-R8 on a wide frame: pack the features into a vector column,
    resample, unpack.  ``categorical`` names the columns that SMOTENC does
    not interpolate."""
    if method == "random":
        return R.oversample_random(df.select(key, label, *features), label, key, seed).drop("synthetic")
    v = df.select(key, label, F.array(*[F.col(f).cast("double") for f in features]).alias("_v"))
    res = R.smote_family(v, label, key, "_v", method, seed=seed,
                         categorical_idx=tuple(i for i, f in enumerate(features) if f in (categorical or ())))
    return res.select(key, label, *[F.col("_v")[i].alias(f) for i, f in enumerate(features)])


def training_figures(oof: DataFrame, scored: DataFrame, label: str, cfg: TR.ModelConfig) -> dict:
    """Figures of out-of-fold predictions (``fold``, ``p1``; M4, recall per fold as E6)
    and of scored test rows (``p1``)."""
    oof = oof.withColumn("pred", E.decide(F.col("p1"), cfg.decision_threshold))
    cvm = E.count_metrics(oof, label, "pred", 1.0).first()
    cells = E.score_cells(oof, label, "p1")
    per_fold = E.count_metrics(oof, label, "pred", 1.0, by=["fold"])
    two = oof.groupBy("fold").agg((F.count_distinct(label) == 2).alias("two_classes"))
    cvs = E.cv_summary(per_fold.join(two, "fold"), "recall").first()
    pt = scored.withColumn("pred", E.decide(F.col("p1"), cfg.decision_threshold))
    tm = E.count_metrics(pt, label, "pred", 1.0).first()
    tcells = E.score_cells(pt, label, "p1")
    n_test = pt.count()
    ci = E.bootstrap_ci(pt.select(label, F.col("p1").alias("score"), "pred").withColumnRenamed(label, "label"),
                        n_boot=cfg.n_bootstraps, alpha=cfg.alpha, seed=cfg.random_state).first()
    z = E.z_value(cfg.alpha)
    acc = tm["accuracy"] or 0.0
    se = (acc * (1 - acc) / n_test) ** 0.5 if n_test else 0.0
    metrics = {
        "cv_accuracy": cvm["accuracy"], "cv_precision": cvm["precision"], "cv_recall": cvm["recall"],
        "cv_f1": cvm["f1"], "cv_roc_auc": E.roc_auc(cells).first()["roc_auc"],
        "cv_pr_auc": E.pr_auc(cells).first()["pr_auc"],
        "cv_score_mean": cvs["cv_score_mean"], "cv_score_std": cvs["cv_score_std"],
        "test_accuracy": tm["accuracy"], "test_precision": tm["precision"], "test_recall": tm["recall"],
        "test_f1": tm["f1"], "test_roc_auc": E.roc_auc(tcells).first()["roc_auc"],
        "test_pr_auc": E.pr_auc(tcells).first()["pr_auc"],
        "accuracy_ci_lower": max(0.0, acc - z * se) if n_test >= 10 else 0.0,
        "accuracy_ci_upper": min(1.0, acc + z * se) if n_test >= 10 else 0.0,
        **{k: ci[k] for k in ci.asDict() if k.endswith(("_lower", "_upper")) and not k.startswith("accuracy")},
    }
    metrics["overfitting_gap"] = abs((metrics["cv_accuracy"] or 0.0) - (metrics["test_accuracy"] or 0.0))
    return {k: (0.0 if v is None or v != v or v < 0 else float(v)) for k, v in metrics.items()}


def train_and_evaluate(prepared: DataFrame, selected: list[str], cfg: TR.ModelConfig,
                       key: str = "user_id", label: str = "ust") -> dict:
    """P24 -> A17 -> R1 -> R3/R5-R8 -> M3 -> T5 -> T8 -> M1 -> E1-E8,
    E11, E12 -> T9.  The final model is fitted on the whole training split
    (not the last CV fold).  Returns metrics, model, features, importances."""
    spark = prepared.sparkSession
    if prepared.agg(F.count_distinct(label)).first()[0] != 2:
        raise ValueError("target must have exactly two classes")
    balance = S.class_balance(prepared, label)
    split = R.stratified_split(prepared.select(key, *selected, label), label, key,
                               cfg.test_size, cfg.random_state).persist(StorageLevel.MEMORY_AND_DISK)
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test")).drop("is_test")
    train = oversample_frame(train, selected, label, key, cfg.oversampling_method, cfg.random_state,
                             cfg.categorical_features)
    if cfg.use_undersampling:
        train = R.undersample(train, label, key, cfg.random_state)
    folded = R.stratified_folds(train, label, key, cfg.n_folds, cfg.random_state).persist(
        StorageLevel.MEMORY_AND_DISK)
    train = compact(folded, folded.count())
    best, grid = TR.grid_search(train, selected, label, cfg)
    params = {"n_trees": best[0]["numTrees"], "depth": best[0]["maxDepth"],
              "min_split": 2 * best[0]["minInstancesPerNode"] - 1, "seed": cfg.random_state}
    wmode = "balanced" if best[0]["weight"] == "w_bal" else cfg.cost_weight
    train_w = TR.with_class_weight(train, label, wmode, "w")
    model = TR.fit_forest(train_w, selected, label, **params)
    chosen = TR.select_by_importance(spark, model, selected, cfg.n_features_to_select)
    chosen, removed, added = TR.vif_replacement(train_w, label, chosen, selected, cfg.max_vif, **params)
    final = TR.fit_forest(train_w, chosen, label, **params)
    oof = TR.out_of_fold(train_w, chosen, label, "fold", cfg.n_folds, params)
    pt = TR.probability_of_one(final.transform(TR.assemble(test, chosen)))
    metrics = training_figures(oof, pt, label, cfg)
    imp = sorted(zip(chosen, [float(x) for x in final.featureImportances.toArray()]),
                 key=lambda t: (-t[1], t[0]))
    folded.unpersist()
    split.unpersist()
    return {"metrics": metrics, "model": final, "features": chosen, "importances": imp,
            "removed": removed, "added": added, "best_params": best, "grid": grid,
            "class_balance": balance, "recall_gap_warning":
                abs(metrics["cv_recall"] - metrics["test_recall"]) > 0.1}


# ---------------------------------------------------------------------- W5
from quire.operators.answers import (group_answers_expr, payload_to_wide, select_answers,  # noqa: E402
                                     validate_payload, wide_to_groups)
from quire.operators.score import predict, route, scale_for_model, scaling_guard  # noqa: E402
from quire.operators.screen import approval, screen  # noqa: E402
from quire.spec import SCORE_DROP_SUFFIXES  # noqa: E402


def payload_features(requests: DataFrame, spec: SurveySpec, key: str = "resp_id",
                     screen_on: str | None = None, grouping: str = "versioned") -> DataFrame:
    """W5 up to the model: P25 or P26 -> P27 -> P28 -> P15 (as a reject
    reason) -> C1 -> F1-F6 -> P20 (``_sum`` dropped).  No explode, no shuffle.

    ``grouping``: ``versioned`` takes version 1 of each group (P25),
    ``dynamic`` every non-empty group whatever its version (P26).
    ``screen_on``: C1 sees the ``recoded`` columns or the ``raw`` answers of
    all groups; by default raw where a group is not recoded.
    """
    if grouping not in ("versioned", "dynamic"):
        raise ValueError(f"unknown grouping {grouping!r}")
    if screen_on is None:
        screen_on = "recoded" if all(c in spec.recode for c in spec.columns) else "raw"
    if screen_on not in ("raw", "recoded"):
        raise ValueError(f"unknown screen_on {screen_on!r}")
    if grouping == "dynamic":
        g = requests.withColumn("_g", F.expr(group_answers_expr("answers")))
    else:
        sel = [{"group": g, "version": "1"} for g in spec.payload_groups]
        g = requests.withColumn("_g", select_answers(F.col("answers"), sel))
    g = g.withColumn("reject_reason", validate_payload(F.col("_g"), spec.payload_groups))
    wide = g.select("*", *payload_to_wide(F.col("_g"), spec)).withColumnRenamed("_g", "_raw").drop("answers")
    in_domain = F.lit(True)
    for c, m in spec.recode.items():
        # a missing answer is outside the domain
        in_domain = in_domain & F.coalesce(F.col(c).isin(*m.keys()), F.lit(False))
    wide = wide.withColumn("reject_reason", F.coalesce(
        F.col("reject_reason"), F.when(~in_domain, F.lit("Data transformation failed"))))
    # recode in place (rows kept; rejected rows carry NULLs)
    rec = wide.select(*[F.when(F.col("reject_reason").isNull(), _recoded(c, spec)).alias(c)
                        if c in spec.recode else F.col(c) for c in wide.columns])
    screened = [c for c in spec.columns if screen_on == "raw" or c in spec.recode]
    stems = list(dict.fromkeys(c.rstrip("0123456789") for c in screened))
    if screen_on == "raw":
        rec = rec.withColumn("_s", screen(F.col("_raw"), stems)).drop("_raw")
    else:
        rec = rec.withColumn("_s", screen(wide_to_groups(spec, screened), stems)).drop("_raw")
    rec = rec.select("*", "_s.screening_passed", "_s.screening_msg").drop("_s")
    eng = engineer(rec, spec)
    return prune_suffixes(eng, SCORE_DROP_SUFFIXES)


def _recoded(c: str, spec: SurveySpec):
    e = None
    for k, v in spec.recode[c].items():
        e = F.when(F.col(c) == k, float(v)) if e is None else e.when(F.col(c) == k, float(v))
    return e


def batch_score(requests: DataFrame, model, scaler: dict, features: list[str],
                spec: SurveySpec = FK_V1, screen_on: str | None = None,
                grouping: str = "versioned") -> DataFrame:
    """Route (C8) -> payload features -> C3/C4/C5 -> C6 approval.

    One row for every request: those that go to no spec, or to another one
    than this model's, are rejected with a reason."""
    routed = route(requests)
    feats = payload_features(routed.where(F.col("spec") == spec.name), spec, screen_on=screen_on,
                             grouping=grouping)
    engineered = [c for c in spec.engineered_columns() if c in feats.columns and c not in (spec.key, spec.target)]
    feats = feats.withColumn("reject_reason", F.coalesce(
        F.col("reject_reason"), scaling_guard(feats, dict.fromkeys([*engineered, *features]))))
    # Stage boundary: the guarded feature rows feed both the scored and the
    # rejected branch; write them once (shared checkpoint folder) instead of
    # planning and computing the wide feature plan twice.
    feats = stored(feats)
    scaled = scale_for_model(feats, scaler, features)
    scored = predict(scaled, model, features).withColumn(
        "approval_loan_status", approval(F.col("screening_passed"), F.col("model_prediction")))
    cols = ["resp_id", "application_label", "reject_reason", "screening_passed", "screening_msg",
            "default_probability", "model_prediction", "adjust_prediction", "approval_loan_status", "used_features"]
    elsewhere = F.concat(F.lit("Routed to "), F.col("spec"))
    unrouted = routed.where(F.col("spec").isNull() | (F.col("spec") != spec.name)).select(
        "resp_id", "application_label", F.coalesce("route_reason", elsewhere).alias("reject_reason"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("screening_passed", "boolean"),
                                                    ("screening_msg", "string"),
                                                    ("default_probability", "double"),
                                                    ("model_prediction", "int"),
                                                    ("adjust_prediction", "int"))],
        F.lit("rejected").alias("approval_loan_status"),
        F.array(*[F.lit(f) for f in features]).alias("used_features"))
    return scored.select(*cols).unionByName(unrouted)


def score_from_registry(requests: DataFrame, root: str, spec: SurveySpec = FK_V1, model_path: str | None = None,
                        scaler_path: str | None = None, **kw) -> DataFrame:
    """W5 by the registry at ``root``: the current version's model and scaler, or those at explicit paths,
    are verified against their checksums (C11, C14) before anything is scored."""
    loaded = PB.load(requests.sparkSession, root, model_path, scaler_path)
    return batch_score(requests, loaded.model, loaded.scaler, loaded.features, spec, **kw)
