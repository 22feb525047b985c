"""W3 without leaks: nothing that is fitted has seen the rows it is judged on.

``train_and_evaluate`` follows the usual order of the job: outliers, scaler and
feature choice are fitted on all rows and over-sampling comes before the folds, so
its cross-validated figures are optimistic.  Here the split comes first, and every
fold fits its own outlier fences, scaler, feature choice and synthetic rows on the other
folds' original rows.  Held rows are original rows only.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import resample as R
from quire.operators import stats as S
from quire.operators import train as TR
from quire.operators.prepare import DataQualityError, enforce, prune_suffixes
from quire.operators.select import top_by
from quire.plans.jobs import oversample_frame, training_figures
from quire.session import compact, cut_lineage
from quire.spec import FK_V1, SurveySpec

#: (feature, run) columns that are profiled together: bounds the plan of one aggregation.
COLUMNS = 240
WHOLE = -1  # the run that is fitted on all training rows and judged on the test rows
_SEP = "__run"


def _cell(feature: str, run: int) -> str:
    return f"{feature}{_SEP}{run if run >= 0 else 'all'}"


def _wide(rows: DataFrame, features: list[str], runs: list[int], keep: list[str], fitting: bool) -> DataFrame:
    """A column for each (feature, run); with ``fitting``, null where the run may not see the row."""
    seen = {r: (F.col("fold") != r if r != WHOLE else F.col("fold").isNotNull()) for r in runs}
    return rows.select(*keep, *[
        (F.when(seen[r], F.col(f)) if fitting else F.col(f)).cast("double").alias(_cell(f, r))
        for r in runs for f in features])


def fit_runs(rows: DataFrame, features: list[str], runs: list[int], method: str = "median") -> tuple[dict, dict]:
    """A1-A3 and A7 of every run: one profile and one scaler fit for ``COLUMNS`` (feature, run) columns,
    not one for each fold.  ``fold`` is null for rows that no run may see.

    Returns the outlier fits and the scaler fits by column name of ``_cell``."""
    cells = [_cell(f, r) for r in runs for f in features]
    fitting = _wide(rows, features, runs, [], True)
    prof, scaler = {}, {}
    for i in range(0, len(cells), COLUMNS):
        some = fitting.select(*cells[i:i + COLUMNS])
        own = S.profile(some, some.columns, S.column_moments(some, some.columns))
        prof |= own
        treated = S.apply_outliers(some, own, method)
        scaler |= S.fit_scaler(treated, some.columns, S.column_moments(treated, some.columns))
    return prof, scaler


def apply_run(rows: DataFrame, features: list[str], run: int, fits: tuple[dict, dict], keep: list[str],
              method: str = "median", round_digits: int = 3) -> DataFrame:
    """A4/A5 -> A8 -> A10 of all rows by one run's fits, under the features' own names."""
    prof, scaler = fits
    own = [_cell(f, run) for f in features]
    wide = _wide(rows, features, [run], keep, False)
    treated = S.apply_outliers(wide, {c: prof[c] for c in own}, method)
    scaled = S.apply_scaler(treated, {c: scaler[c] for c in own}, round_digits)
    return scaled.select(*keep, *[F.col(_cell(f, run)).alias(f) for f in features])


def _usable(features: list[str], run: int, scaler: dict, prof: dict) -> list[str]:
    """Features that vary over the run's rows."""
    return [f for f in features if prof[_cell(f, run)]["var_samp"] and scaler[_cell(f, run)]["scale"]]


def _chosen(fit: DataFrame, features: list[str], label: str, n: int | None) -> list[str]:
    """T1 on the rows a run may see; ``n`` None keeps all features."""
    if n is None:
        return features
    corr = S.correlation_table(fit, features, label)
    return [r["feature"] for r in top_by(corr, "spearman", n).orderBy("position").collect()]


def _written(df: DataFrame) -> DataFrame:
    """The checkpointed rows in partitions that suit their number: every fit reads them."""
    out = cut_lineage(df)
    return compact(out, out.count())


def _raised(fit: DataFrame, features: list[str], label: str, key: str, cfg: TR.ModelConfig) -> DataFrame:
    out = oversample_frame(fit, features, label, key, cfg.oversampling_method, cfg.random_state, cfg.categorical_features)
    return R.undersample(out, label, key, cfg.random_state) if cfg.use_undersampling else out


def train_leak_free(features: DataFrame, cfg: TR.ModelConfig, candidates: list[str] | None = None,
                    n_select: int | None = 10, spec: SurveySpec = FK_V1, method: str = "median",
                    drop_suffixes=("_sum", "_count", "_var"), parallelism: int = 4) -> dict:
    """R1 -> R2, then for each fold A1-A5, A7-A10, T1, R3/R5-R8, M3 on the other folds; the final run fits the
    same on all training rows, then T5 -> T8 -> M1; E1-E8, E11, E12, T9.

    ``features`` is the engineered frame, neither treated nor scaled.  Grid points are compared by
    their mean score on held original rows.  The cross-validated figures are those of the best
    point's fold models; each fold uses the features that it chose.  ``DataQualityError`` if the target
    has not two classes or a run can choose no feature.

    Returns what ``train_and_evaluate`` does, with the final run's ``scaler`` and ``outliers``, and
    each fold's own fits in ``folds`` (features, outliers, scaler).
    """
    if cfg.scoring not in ("f1", "precision", "recall", "accuracy", "roc_auc"):
        raise ValueError(f"unknown scoring {cfg.scoring!r}")
    spark, key, label, k = features.sparkSession, spec.key, spec.target, cfg.n_folds
    frame = prune_suffixes(features, drop_suffixes)
    if candidates is None:
        candidates = [c for c in frame.columns if c not in (key, label)]
    frame = frame.select(key, *candidates, label)
    enforce(frame, "leak_free", target=label)
    split = R.stratified_split(frame, label, key, cfg.test_size, cfg.random_state)
    folds = R.stratified_folds(split.where(~F.col("is_test")), label, key, k, cfg.random_state)
    # one frame carries the folds; test rows have none, so no run sees them
    rows = folds.unionByName(split.where("is_test").withColumn("fold", F.lit(None).cast("int")))
    rows = _written(rows)
    runs = [*range(k), WHOLE]
    prof, scaler = fit_runs(rows, candidates, runs, method)
    keep = [key, label, "fold"]
    chosen, fitted, held, cached = {}, {}, {}, []
    try:
        def prepare(r):
            usable = _usable(candidates, r, scaler, prof)
            mine = apply_run(rows, usable, r, (prof, scaler), keep, method)
            fit = mine.where(F.col("fold") != r) if r != WHOLE else mine.where("fold is not null")
            fit = fit.drop("fold").persist(StorageLevel.MEMORY_AND_DISK)
            cached.append(fit)
            chosen[r] = _chosen(fit, usable, label, n_select)
            if not chosen[r]:
                raise DataQualityError(f"no feature was selected in run {r}")
            raised = _raised(fit.select(key, label, *chosen[r]), chosen[r], label, key, cfg)
            raised = TR.with_class_weight(raised, label, "balanced", "w_bal")
            raised = TR.with_class_weight(raised, label, cfg.cost_weight, "w_cost")
            # synthetic rows are drawn once, for all grid points
            fitted[r] = _written(raised.select(key, label, *chosen[r], "w_bal", "w_cost"))
            out = mine.where(F.col("fold") == r) if r != WHOLE else mine.where("fold is null")
            held[r] = out.select(key, label, *chosen[r]).persist(StorageLevel.MEMORY_AND_DISK)
            cached.append(held[r])

        TR.side_by_side(prepare, runs, parallelism)
        best, grid = _grid(fitted, held, chosen, range(k), label, cfg, parallelism)
        weight = best[0]["weight"]
        params = {"n_trees": best[0]["numTrees"], "depth": best[0]["maxDepth"],
                  "min_split": 2 * best[0]["minInstancesPerNode"] - 1, "seed": cfg.random_state}

        def judged(r):
            m = TR.fit_forest(fitted[r], chosen[r], label, weight=weight, **params)
            return TR.probability_of_one(m.transform(TR.assemble(held[r], chosen[r]))).select(
                key, label, F.lit(r).alias("fold"), "p1")

        oof = cut_lineage(reduce(DataFrame.unionByName, TR.side_by_side(judged, range(k), parallelism)))
        whole = fitted[WHOLE].withColumn("w", F.col(weight))
        first = TR.fit_forest(whole, chosen[WHOLE], label, weight="w", **params)
        final = TR.select_by_importance(spark, first, chosen[WHOLE], cfg.n_features_to_select)
        final, removed, added = TR.vif_replacement(whole, label, final, chosen[WHOLE], cfg.max_vif, **params)
        model = TR.fit_forest(whole, final, label, weight="w", **params)
        scored = cut_lineage(TR.probability_of_one(model.transform(TR.assemble(held[WHOLE], final))).select(key, label, "p1"))
        metrics = training_figures(oof, scored, label, cfg)
        balance = S.class_balance(frame, label)
    finally:
        for c in cached:
            c.unpersist()
    imp = sorted(zip(final, [float(x) for x in model.featureImportances.toArray()]), key=lambda t: (-t[1], t[0]))
    own = lambda fits, r: {f: fits[_cell(f, r)] for f in candidates}
    return {"metrics": metrics, "model": model, "features": final, "importances": imp, "removed": removed,
            "added": added, "best_params": best, "grid": grid, "class_balance": balance, "out_of_fold": oof,
            "scaler": own(scaler, WHOLE), "outliers": own(prof, WHOLE),
            "folds": {r: {"features": chosen[r], "outliers": own(prof, r), "scaler": own(scaler, r)} for r in range(k)},
            "recall_gap_warning": abs(metrics["cv_recall"] - metrics["test_recall"]) > 0.1}


def _grid(fitted: dict, held: dict, chosen: dict, folds, label: str, cfg: TR.ModelConfig,
          parallelism: int) -> tuple[tuple, list]:
    """M3 where each fold has its own training rows: the mean score of every point over the folds.

    MLlib's cross-validator trains and validates on rows of one frame, so it cannot be used here.  As
    there, ``parallelism`` fits are under way at a time.
    """
    data = {r: (TR.assemble(fitted[r], chosen[r]).select(label, "features", "w_bal", "w_cost").persist(StorageLevel.MEMORY_AND_DISK),
                TR.assemble(held[r], chosen[r]).select(label, "features")) for r in folds}
    depths = [TR.MAX_TREE_DEPTH if d is None else d for d in cfg.max_depth]
    leaves = sorted({max(1, (s + 1) // 2) for s in cfg.min_samples_split})
    points = [{"numTrees": t, "maxDepth": d, "minInstancesPerNode": m, "weight": w}
              for w, t, d, m in product(("w_bal", "w_cost"), cfg.n_estimators, depths, leaves)]
    evaluator = TR.scorer(cfg.scoring, label)

    def score(point: dict, r: int) -> float:
        rf = TR.forest(label, point["numTrees"], point["maxDepth"], 2 * point["minInstancesPerNode"] - 1,
                       cfg.random_state, point["weight"])
        return float(evaluator.evaluate(rf.fit(data[r][0]).transform(data[r][1])))

    try:
        scores = TR.side_by_side(lambda a: score(*a), [(p, r) for p in points for r in folds], parallelism)
    finally:
        for fit, _ in data.values():
            fit.unpersist()
    n = len(list(folds))
    grid = [(p, float(np.mean(scores[i * n:(i + 1) * n]))) for i, p in enumerate(points)]
    return max(grid, key=lambda t: t[1]), grid
