"""Evaluation aggregates.

Inputs are (label 0/1, score) rows, optionally with a row weight and a
grouping column (fold, bootstrap replicate).  Count metrics are conditional
sums in one aggregation.  Curve metrics compress rows to one cell per
distinct score first; cumulative counts then come from a prefix sum over
ranges of the cells, as many as their number asks for, never from a window over
raw rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.prefix import PART, PART_ROWS, lay_out, prefix_sums, sums_before
from quire.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1")


def decide(score: Column, threshold: float = 0.5) -> Column:
    """Class 1 when p >= threshold."""
    return (score >= F.lit(threshold)).cast("int")


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(label, pred, n) cells."""
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def _w(weight):
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def count_metrics(df: DataFrame, label: str = "label", pred: str = "pred", zero_division: float = 1.0,
                  weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (+ tp/fp/tn/fn), one aggregation;
    an undefined ratio takes ``zero_division``."""
    y, p, w = F.col(label), F.col(pred), _w(weight)
    aggs = [F.sum(F.when((y == 1) & (p == 1), w).otherwise(0.0)).alias("tp"),
            F.sum(F.when((y == 0) & (p == 1), w).otherwise(0.0)).alias("fp"),
            F.sum(F.when((y == 0) & (p == 0), w).otherwise(0.0)).alias("tn"),
            F.sum(F.when((y == 1) & (p == 0), w).otherwise(0.0)).alias("fn")]
    g = df.groupBy(*(by or [])).agg(*aggs)
    return g.select(*(by or []), *metric_columns(zero_division), "tp", "fp", "tn", "fn")


def metric_columns(z: float = 1.0) -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    zl = F.lit(float(z))
    prec = F.coalesce(F.try_divide(tp, tp + fp), zl)
    rec = F.coalesce(F.try_divide(tp, tp + fn), zl)
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zl)
    return [F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"),
            rec.alias("recall"), f1.alias("f1")]


def score_cells(df: DataFrame, label: str = "label", score: str = "score", weight: str | None = None,
                by: list[str] | None = None) -> DataFrame:
    """(by.., score, pos, neg): weighted class counts per distinct score."""
    y, w = F.col(label), _w(weight)
    return df.groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0.0)).alias("neg"))


def roc_auc(cells: DataFrame, by: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Mann-Whitney AUC with ties counted half, from score cells:
    sum_c pos_c * (neg below c + neg_c / 2) / (P * N); NULL for one class."""
    by = by or []
    c = prefix_sums(cells, by, "score", ["neg"], part_rows)
    g = c.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"),
                           F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                F.col("u") / (F.col("P") * F.col("N"))).alias("roc_auc"))


def pr_auc(cells: DataFrame, by: list[str] | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """E5: trapezoid area under the precision-recall curve with the end
    point (recall 0, precision 1); thresholds are the distinct scores.

    At threshold s: tp = P - pos_below(s), fp = N - neg_below(s); the
    previous (higher) threshold has tp - pos_s and fp - neg_s, so each
    trapezoid is local to its cell."""
    out_by = by or []
    if not by:
        cells, by = cells.withColumn("_g", F.lit(0)), ["_g"]
    c = cut_lineage(prefix_sums(cells, by, "score", ["pos", "neg"], part_rows))
    # per-group totals: one row per group, joined back on the group key
    tot = c.join(c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), by)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    ptp, pfp = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prev_prec = F.when(ptp + pfp > 0, ptp / (ptp + pfp)).otherwise(F.lit(1.0))
    area = (tp - ptp) / F.col("P") * (prec + prev_prec) / 2
    g = tot.groupBy(*by).agg(F.sum(area).alias("a"), F.first("P").alias("P"))
    return g.select(*out_by, F.when(F.col("P") > 0, F.col("a")).alias("pr_auc"))


def cv_summary(per_fold: DataFrame, metric: str = "recall", fold: str = "fold",
               valid: str = "two_classes") -> DataFrame:
    """Mean and population std of a per-fold metric over folds that
    hold both classes."""
    f = per_fold.where(F.col(valid))
    return f.agg(F.avg(metric).alias("cv_score_mean"), F.stddev_pop(metric).alias("cv_score_std"),
                 F.count(F.lit(1)).alias("folds"))


def z_value(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def accuracy_ci(acc: Column, n: Column, alpha: float = 0.05) -> list[Column]:
    """Normal-approximation CI of accuracy, clipped to [0, 1]."""
    z = z_value(alpha)
    se = F.sqrt(acc * (1 - acc) / n)
    return [F.greatest(F.lit(0.0), acc - z * se).alias("accuracy_ci_lower"),
            F.least(F.lit(1.0), acc + z * se).alias("accuracy_ci_upper")]


def per_class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support with each class as positive
    (zero division -> 0)."""
    cm = confusion(df, label, pred)
    rows = []
    for k in (0, 1):
        y, p, n = F.col(label), F.col(pred), F.col("n").cast("double")
        rows.append(cm.groupBy().agg(
            F.sum(F.when((y == k) & (p == k), n).otherwise(0.0)).alias("tp"),
            F.sum(F.when((y != k) & (p == k), n).otherwise(0.0)).alias("fp"),
            F.sum(F.when((y == k) & (p != k), n).otherwise(0.0)).alias("fn"))
            .select(F.lit(k).alias("class"),
                    F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                               F.lit(0.0)).alias("f1"),
                    (F.col("tp") + F.col("fn")).cast("bigint").alias("support")))
    return rows[0].unionByName(rows[1])


def overfit_gap(cv_acc: Column, test_acc: Column) -> Column:
    """|cv accuracy - test accuracy|."""
    return F.abs(cv_acc - test_acc)


def sanitise(c: Column) -> Column:
    """NaN / NULL / negative -> 0."""
    return F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(0.0)).otherwise(c)


# ------------------------------------------------------------------ E8 / E9
#: Cells of one range in the bootstrap, and distinct scores whose replicates a task holds at once.
BOOT_ROWS, BOOT_BLOCK = 50_000, 256
COUNTS = ("tp", "fp", "tn", "fn")


def poisson_counts(rows: float, key: int, seed: int, n: int) -> np.ndarray:
    """``n`` draws of Poisson(rows): how often a cell of so many rows is drawn in ``n`` replicates.

    Rows drawn Poisson(1) times each come to Poisson(rows) in all.  The generator is a counter
    hashed with (key, seed), so a cell's draws do not depend on its task; the sampler is
    transformed rejection, whose time does not grow with ``rows``.
    """
    mask = (1 << 64) - 1
    return np.random.Generator(np.random.Philox(key=[key & mask, seed & mask])).poisson(rows, n).astype("float64")


def replicate_blocks(cells: pd.DataFrame, n_boot: int, seed: int):
    """Blocks of a range's distinct scores, rising: class counts (pos, neg: scores x replicates) and the confusion counts."""
    cells = cells.sort_values(["score", "label", "pred"], kind="stable")
    score, label, pred = (cells[c].to_numpy() for c in ("score", "label", "pred"))
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]])) if len(score) else np.zeros(0, "int64")
    ends = np.append(first, len(score))
    for at in range(0, len(first), BOOT_BLOCK):
        lo, hi = ends[at], ends[min(at + BOOT_BLOCK, len(first))]
        w = np.stack([poisson_counts(m, k, seed, n_boot) for m, k in zip(cells["m"].iloc[lo:hi], cells["key"].iloc[lo:hi])])
        y, p, starts = label[lo:hi] == 1, pred[lo:hi] == 1, first[at:at + BOOT_BLOCK] - lo
        yield (np.add.reduceat(w * y[:, None], starts), np.add.reduceat(w * ~y[:, None], starts),
               {"tp": w[y & p].sum(axis=0), "fp": w[~y & p].sum(axis=0), "tn": w[~y & ~p].sum(axis=0), "fn": w[y & ~p].sum(axis=0)})


def replicate_totals(laid: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``PART, b`` with confusion counts and ``u``, the pairs (positive above negative, ties half) inside the range."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, below, u = {c: np.zeros(n_boot) for c in COUNTS}, np.zeros(n_boot), np.zeros(n_boot)
        for pos, neg, counts in replicate_blocks(pdf, n_boot, seed):
            under = below + np.cumsum(neg, axis=0) - neg
            u += (pos * (under + neg / 2)).sum(axis=0)
            below = below + neg.sum(axis=0)
            for c in COUNTS:
                out[c] += counts[c]
        return pd.DataFrame({PART: int(pdf[PART].iloc[0]), "b": np.arange(n_boot), **out, "u": u})

    return laid.groupBy(PART).applyInPandas(run, f"{PART} int, b int, " + ", ".join(f"{c} double" for c in (*COUNTS, "u")))


def replicate_areas(laid: DataFrame, before: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """``b, area``: each range's part of the area under the precision-recall curve.

    ``before`` holds, for each range and replicate, the counts of lower ranges (``pos``, ``neg``) and all (``P``, ``N``).
    """

    def run(cells: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("b")
        p_left, n_left = (known[a].to_numpy() - known[b].to_numpy() for a, b in (("P", "pos"), ("N", "neg")))
        total, area = known["P"].to_numpy(), np.zeros(n_boot)
        with np.errstate(divide="ignore", invalid="ignore"):
            for pos, neg, _ in replicate_blocks(cells, n_boot, seed):
                tp, fp = p_left - (np.cumsum(pos, axis=0) - pos), n_left - (np.cumsum(neg, axis=0) - neg)
                above_tp, above_fp = tp - pos, fp - neg
                here = np.where(tp + fp > 0, tp / (tp + fp), 1.0)
                higher = np.where(above_tp + above_fp > 0, above_tp / (above_tp + above_fp), 1.0)
                # A score that no row of the replicate has is no point of its curve: pos = 0 adds nothing.
                area += (pos / total * (here + higher) / 2).sum(axis=0)
                p_left, n_left = above_tp[-1], above_fp[-1]
        return pd.DataFrame({"b": np.arange(n_boot), "area": area})

    return (laid.groupBy(PART).cogroup(before.groupBy(PART)).applyInPandas(run, "b int, area double"))


def bootstrap_ci(df: DataFrame, label: str = "label", score: str = "score", pred: str = "pred",
                 n_boot: int = 500, alpha: float = 0.05, seed: int = 42, with_accuracy: bool = False,
                 with_pr_auc: bool = True, widen_equal: float = 0.0, part_rows: int = BOOT_ROWS) -> DataFrame:
    """E8 (E9 with ``with_accuracy``, ``with_pr_auc=False`` and ``widen_equal=0.01``): percentile CI
    of precision, recall, F1 (zero division 0), ROC AUC and PR AUC over
    Poisson bootstrap replicates.

    Rows are first compressed to (score, label, pred) cells, laid out in ranges of scores.  A cell draws its
    counts in all replicates at once (``poisson_counts``), so the work is cells x
    replicates whatever the number of rows; prefix sums run along the cells for all
    replicates together.  The second curve needs what lies below a range and draws again, with the same
    result.  Replicates with one class are skipped; fewer than 10
    valid replicates, fewer than 10 rows or a single class give 0 bounds.
    """
    cells = (df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label"),
                       F.col(pred).cast("int").alias("pred")).where(F.col("label").isin(0, 1))
             .groupBy("score", "label", "pred").agg(F.count(F.lit(1)).cast("double").alias("m"))
             .withColumn("key", F.xxhash64("score", "label", "pred")))
    laid = lay_out(cells, ["score"], part_rows)
    totals = cut_lineage(replicate_totals(laid, n_boot, seed))
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    classes = totals.select(PART, "b", (tp + fn).alias("pos"), (fp + tn).alias("neg"))
    before = sums_before(classes, ["b"], ["pos", "neg"])
    pairs = totals.join(before, [PART, "b"]).groupBy("b").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum(F.col("u") + (tp + fn) * F.col("neg")).alias("u"))
    per = pairs.where((tp + fn > 0) & (fp + tn > 0)).select(
        "b", *metric_columns(0.0), (F.col("u") / ((tp + fn) * (fp + tn))).alias("roc_auc"))
    if with_pr_auc:
        whole = classes.groupBy("b").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        areas = replicate_areas(laid, before.join(whole, "b"), n_boot, seed)
        per = per.join(areas.groupBy("b").agg(F.sum("area").alias("pr_auc")), "b")
    names = (["accuracy"] if with_accuracy else []) + ["precision", "recall", "f1", "roc_auc"] + (["pr_auc"] if with_pr_auc else [])
    lo_p, hi_p = alpha / 2, 1 - alpha / 2
    aggs = [F.count(F.lit(1)).alias("valid")]
    for m in names:
        aggs += [F.percentile(m, lo_p).alias(f"{m}_lo"), F.percentile(m, hi_p).alias(f"{m}_hi"),
                 F.count(m).alias(f"{m}_n")]
    agg = per.agg(*aggs)
    base = laid.agg(F.sum("m").alias("n_rows"), F.count_distinct("label").alias("n_classes"))
    j = agg.withColumn("_g", F.lit(0)).join(base.withColumn("_g", F.lit(0)), "_g")
    out = []
    ok = (F.col("n_rows") >= 10) & (F.col("n_classes") >= 2)
    for m in names:
        lo, hi = F.col(f"{m}_lo"), F.col(f"{m}_hi")
        good = ok & (F.col(f"{m}_n") >= 10)
        if widen_equal:
            lo2 = F.when(lo == hi, F.greatest(F.lit(0.0), lo - widen_equal)).otherwise(lo)
            hi2 = F.when(lo == hi, F.least(F.lit(1.0), hi + widen_equal)).otherwise(hi)
            lo, hi = lo2, hi2
        out += [F.when(good, lo).otherwise(0.0).alias(f"{m}_ci_lower"),
                F.when(good, hi).otherwise(0.0).alias(f"{m}_ci_upper")]
    return j.select(*out, "valid")
