"""Model jobs (M1-M4) and model-based selection (T5-T9) on MLlib.

MLlib owns the learners' inner loops (distributed tree/gradient
aggregation).  Selection loops iterate over a handful of features and
refit; the VIF loop reads sub-matrices of one Gram pass, so only the
importance refits touch the data.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import evaluate as E
from quire.operators.stats import gram, vif_from_gram
from quire.session import compact, cut_lineage


@dataclass
class ModelConfig:
    """Trainer configuration; defaults are the reference's."""
    n_estimators: list = field(default_factory=lambda: [50, 100, 200])
    max_depth: list = field(default_factory=lambda: [3, 5, 10, None])
    min_samples_split: list = field(default_factory=lambda: [2, 5, 10])
    n_features_to_select: int = 10
    n_folds: int = 5
    scoring: str = "f1"
    random_state: int = 42
    oversampling_method: str = "borderline"
    categorical_features: list = field(default_factory=list)
    use_undersampling: bool = False
    max_vif: float = 1.5
    n_bootstraps: int = 500
    alpha: float = 0.05
    test_size: float = 0.2
    decision_threshold: float = 0.5
    cost_weight: dict = field(default_factory=lambda: {0: 1, 1: 1})

    def __post_init__(self):
        if self.scoring not in ("accuracy", "precision", "recall", "f1", "roc_auc"):
            raise ValueError(f"invalid scoring metric: {self.scoring}")
        if self.n_folds < 2 or self.n_features_to_select < 1 or self.max_vif <= 0:
            raise ValueError("invalid configuration")
        if not (0 < self.alpha < 1 and 0 < self.test_size < 1 and 0 < self.decision_threshold < 1):
            raise ValueError("alpha, test_size and decision_threshold must be in (0, 1)")


MAX_TREE_DEPTH = 30  # MLlib's cap stands in for an unlimited depth
KEPT_NODES_DEPTH = 5  # up to this depth the way from the root costs no more than keeping each row's node


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def with_class_weight(df: DataFrame, label: str, mode="balanced", out: str = "w") -> DataFrame:
    """M1 class weights: 'balanced' = n / (2 n_c); a dict maps class -> cost."""
    if isinstance(mode, dict):
        m = F.create_map(*[x for k, v in mode.items() for x in (F.lit(int(k)), F.lit(float(v)))])
        return df.withColumn(out, F.element_at(m, F.col(label).cast("int")))
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n, k = sum(counts.values()), len(counts)
    m = F.create_map(*[x for c, v in counts.items() for x in (F.lit(c), F.lit(n / (k * v)))])
    return df.withColumn(out, F.element_at(m, F.col(label)))


def forest(label: str = "ust", n_trees: int = 100, depth=None, min_split: int = 2, seed: int = 42,
           weight: str | None = "w") -> RandomForestClassifier:
    """M1: sklearn-like forest.  ``min_samples_split`` has no exact MLlib
    twin; it maps to minInstancesPerNode = ceil(min_split / 2)."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=n_trees,
                                maxDepth=MAX_TREE_DEPTH if depth is None else depth,
                                minInstancesPerNode=max(1, (min_split + 1) // 2), seed=seed,
                                featureSubsetStrategy="sqrt", bootstrap=True)
    # A level's pass sends every row down each tree from its root unless the rows' nodes are kept; the trees are the same.
    rf.setCacheNodeIds(rf.getMaxDepth() > KEPT_NODES_DEPTH)
    if weight:
        rf.setWeightCol(weight)
    return rf


@contextmanager
def held(df: DataFrame):
    """The rows kept in memory (and on disk) for a loop of fits, in partitions that suit their number."""
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield compact(rows, rows.count())
    finally:
        rows.unpersist()


#: Fits that are under way at a time.
PARALLEL = 4


def side_by_side(work, items, parallelism: int = PARALLEL) -> list:
    """``work`` of every item, in order, ``parallelism`` at a time.  A fit is a row of short jobs with the
    driver's own work between them; one alone leaves most cores idle.  The results are those of a loop."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(work, items))


def fit_forest(df: DataFrame, features: list[str], label: str = "ust", **kw):
    return forest(label, **kw).fit(assemble(df, features))


def importance_table(spark, model, features: list[str]) -> DataFrame:
    """(feature, importance) sorted descending."""
    imp = model.featureImportances.toArray()
    rows = sorted(zip(features, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE")


def logistic(label: str = "ust", weight: str | None = "w", max_iter: int = 1000, n_rows: int | None = None):
    """M2: L2 logistic regression; sklearn's C=1 on a summed loss equals
    regParam = 1 / n on MLlib's averaged loss."""
    lr = LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter,
                            regParam=(1.0 / n_rows) if n_rows else 0.0, elasticNetParam=0.0)
    if weight:
        lr.setWeightCol(weight)
    return lr


def probability_of_one(pred: DataFrame, out: str = "p1") -> DataFrame:
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


def scorer(metric: str, label: str):
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction",
                                             metricName="areaUnderROC")
    name = {"f1": "fMeasureByLabel", "precision": "precisionByLabel", "recall": "recallByLabel",
            "accuracy": "accuracy"}[metric]
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=name)
    if metric != "accuracy":
        ev.setMetricLabel(1.0)
    return ev


def grid_search(df: DataFrame, features: list[str], label: str, cfg: ModelConfig, fold: str = "fold",
                parallelism: int = 4):
    """M3: grid over trees x depth x min split x class weighting, k folds
    given by ``fold`` (stratified, R2), best by ``cfg.scoring``.

    The fits are those of MLlib's cross-validator, without its copies of each fold's
    rows and its last fit on all rows, which nothing reads.  ``df`` is passed over several times a fit."""
    data = assemble(with_class_weight(df, label, "balanced", "w_bal"), features)
    data = with_class_weight(data, label, cfg.cost_weight, "w_cost").select(
        label, "features", "w_bal", "w_cost", F.col(fold).cast("int").alias(fold))
    seen = {r[0] for r in data.groupBy(fold).count().collect()}
    if not seen <= {*range(cfg.n_folds), None}:
        raise ValueError(f"Fold number must be in range [0, {cfg.n_folds})")
    if not {*range(cfg.n_folds)} <= seen:
        raise ValueError("a fold is empty")
    depths = [MAX_TREE_DEPTH if d is None else d for d in cfg.max_depth]
    leaves = sorted({max(1, (s + 1) // 2) for s in cfg.min_samples_split})
    points = [{"numTrees": t, "maxDepth": d, "minInstancesPerNode": m} for t, d, m in product(cfg.n_estimators, depths, leaves)]
    evaluator = scorer(cfg.scoring, label)

    def validated(wcol):
        def score(point, f):
            rf = forest(label, point["numTrees"], point["maxDepth"], 2 * point["minInstancesPerNode"] - 1, cfg.random_state, wcol)
            return float(evaluator.evaluate(rf.fit(data.where(F.col(fold) != f)).transform(data.where(F.col(fold) == f))))

        with ThreadPoolExecutor(max(1, parallelism // 2)) as pool:
            scores = list(pool.map(lambda a: score(*a), [(p, f) for p in points for f in range(cfg.n_folds)]))
        return [(p | {"weight": wcol}, float(np.mean(scores[i * cfg.n_folds:(i + 1) * cfg.n_folds]))) for i, p in enumerate(points)]

    results = [r for part in side_by_side(validated, ("w_bal", "w_cost")) for r in part]
    best = max(results, key=lambda t: t[1])
    return best, results


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, k: int,
                params: dict | None = None, estimator=None) -> DataFrame:
    """M4: for each fold, fit on the others and score it; union of folds.

    ``estimator(rows)`` gives the learner for one fold's training rows; by
    default it is a forest with ``params``.  The scored rows are written once (shared checkpoint folder):
    figures read them many times."""
    with held(assemble(df, features)) as data:
        return fold_predictions(data, label, fold, k, params, estimator)


def fold_predictions(data: DataFrame, label: str, fold: str, k: int, params: dict | None = None, estimator=None,
                     parallelism: int = PARALLEL) -> DataFrame:
    """M4 on rows that are held and assembled, so that several learners share them."""
    params = params or {}

    def scored(f):
        rows = data.where(F.col(fold) != f)
        m = (estimator(rows) if estimator else forest(label, **params)).fit(rows)
        return probability_of_one(m.transform(data.where(F.col(fold) == f)))

    parts = side_by_side(scored, range(k), parallelism)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut_lineage(out.drop("features", "rawPrediction", "probability"))


def select_by_importance(spark, model, features: list[str], max_features: int) -> list[str]:
    """T5: importance >= mean importance, at most ``max_features`` of the
    most important, in column order."""
    imp = model.featureImportances.toArray()
    mean = float(np.mean(imp))
    ranked = sorted([(f, float(v)) for f, v in zip(features, imp) if v >= mean],
                    key=lambda t: (-t[1], t[0]))
    chosen = {f for f, _ in ranked[:max_features]}
    return [f for f in features if f in chosen]


def recursive_elimination(df: DataFrame, features: list[str], label: str, n_keep: int, **kw) -> list[str]:
    """Refit and drop the least important feature, one per round, down
    to max(n_keep, p / 2) features."""
    cur = list(features)
    target = max(n_keep, len(features) // 2)
    with held(df) as rows:
        while len(cur) > target:
            m = fit_forest(rows, cur, label, **kw)
            imp = m.featureImportances.toArray()
            cur.pop(int(np.argmin(imp)))
    return cur


def backward_elimination(train: DataFrame, test: DataFrame, features: list[str], label: str,
                         n_rows: int | None = None) -> tuple[list[str], float]:
    """Logistic model; drop the smallest |coefficient| while test ROC
    AUC does not fall.  Returns the earliest set of the best AUC: a smaller
    set replaces it only by a strict gain."""
    def auc(feats):
        m = logistic(label, "w", n_rows=n_rows).fit(assemble(train, feats))
        p = probability_of_one(m.transform(assemble(test, feats)))
        a = E.roc_auc(E.score_cells(p, label, "p1")).first()["roc_auc"]
        return m, (a if a is not None else 0.0)

    cur = list(features)
    model, now = auc(cur)
    kept, best = cur, now
    while len(cur) > 1:
        coef = np.abs(model.coefficients.toArray())
        cand = cur[:int(np.argmin(coef))] + cur[int(np.argmin(coef)) + 1:]
        m2, a2 = auc(cand)
        if a2 < now:
            break
        cur, model, now = cand, m2, a2
        if now > best:
            kept, best = cur, now
    return kept, best


def vif_replacement(df: DataFrame, label: str, selected: list[str], pool: list[str],
                    max_vif: float = 1.5, **kw) -> tuple[list[str], list[str], list[str]]:
    """While some selected feature has VIF > max_vif (collinear counts as
    high), drop the least important of them and add the most important
    candidate keeping every VIF <= max_vif; at most 2p rounds.  VIFs of
    every subset come from ONE Gram pass over the pool."""
    g = gram(df, list(dict.fromkeys(selected + pool)))

    def vifs(feats):
        return {f: (np.inf if c else v) for f, v, c in vif_from_gram(g, feats)}

    cur, removed, added = list(selected), [], []
    model = fit_forest(df, cur, label, **kw)
    imp = dict(zip(cur, model.featureImportances.toArray()))
    all_imp = None
    for _ in range(2 * len(selected)):
        v = vifs(cur)
        high = [f for f in cur if v[f] > max_vif]
        if not high:
            break
        drop = min(high, key=lambda f: (imp.get(f, 0.0), f))
        cur.remove(drop)
        removed.append(drop)
        cands = [f for f in pool if f not in cur]
        if not cands:
            break
        if all_imp is None:
            m_all = fit_forest(df, pool, label, **kw)
            all_imp = dict(zip(pool, m_all.featureImportances.toArray()))
        for cand in sorted(cands, key=lambda f: (-all_imp.get(f, 0.0), f)):
            if max(vifs(cur + [cand]).values()) <= max_vif:
                cur.append(cand)
                added.append(cand)
                break
        if not cur:
            break
        model = fit_forest(df, cur, label, **kw)
        imp = dict(zip(cur, model.featureImportances.toArray()))
    return cur, removed, added
