"""Column statistics.

Every fit computes all of its columns in ONE aggregation (partial
aggregation map-side, one tiny shuffle) and returns plain Python numbers;
every apply is a lazy projection.  Rank statistics never window over raw
rows: they compress to distinct values first and compute exact mid-ranks
with a two-level prefix sum, so no task holds a whole column.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.exprs import round_half_even
from quire.functions.prefix import PART_ROWS, prefix_sums
from quire.functions.quantiles import exact_quantiles
from quire.session import cut_lineage


# ------------------------------------------------------------------ A1 - A3
def profile(df: DataFrame, columns: list[str], moments: dict | None = None) -> dict:
    """Sample variance, population skewness (g1), quartiles (linear
    interpolation) and median for every column: the moments in one
    aggregation, or those of ``column_moments``, the quartiles by ``exact_quantiles``.
    """
    if moments is None:
        aggs = []
        for i, c in enumerate(columns):
            x = F.col(c).cast("double")
            aggs += [F.var_samp(x).alias(f"v{i}"), F.skewness(x).alias(f"s{i}"), F.count(x).alias(f"n{i}")]
        row = df.agg(*aggs).first()
        spread = {c: (row[f"v{i}"], row[f"s{i}"], row[f"n{i}"]) for i, c in enumerate(columns)}
    else:
        spread = {c: (None if n < 2 else m2 / (n - 1), None if m2 == 0 else math.sqrt(n) * m3 / math.sqrt(m2 * m2 * m2), n)
                  for c, (n, _, m2, m3) in moments.items()}
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75))
    out = {}
    for c in columns:
        q1, med, q3 = quartiles[c]
        iqr = None if q1 is None else q3 - q1
        variance, skewness, n = spread[c]
        out[c] = {"var_samp": variance, "skewness": skewness, "q1": q1, "median": med,
                  "q3": q3, "iqr": iqr,
                  "lower": None if iqr is None else q1 - 1.5 * iqr,
                  "upper": None if iqr is None else q3 + 1.5 * iqr, "n": n}
    return out


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(4, columns): count, mean, second and third central sums of two disjoint sets of rows taken together."""
    (na, ma, sa, ta), (nb, mb, sb, tb) = a, b
    n = np.maximum(na + nb, 1.0)
    gap = np.where((na > 0) & (nb > 0), mb - ma, 0.0)  # an empty side has mean 0 and must not move the other's
    return np.stack([na + nb, np.where(na > 0, ma + gap * nb / n, mb), sa + sb + gap * gap * na * nb / n,
                     ta + tb + gap ** 3 * na * nb * (na - nb) / n ** 2 + 3 * gap * (na * sb - nb * sa) / n])


def column_moments(df: DataFrame, columns: list[str]) -> dict:
    """(count, mean, second and third central sums) of every column over its values that are not null.

    Some hundreds of columns are one projection here, where one aggregation of as many moments is too
    long for the JVM to compile.  A task hands on four numbers a column; a constant column's sums are exactly 0."""
    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((4, len(columns)))
        with np.errstate(all="ignore"):
            for batch in batches:
                block = np.zeros((4, len(columns)))
                for i, column in enumerate(batch.columns):
                    x = column.drop_null().to_numpy(zero_copy_only=False)
                    if len(x):
                        near = x - x[0]
                        mean = near.mean()
                        off = near - mean
                        square = off * off
                        block[:, i] = len(x), x[0] + mean, square.sum(), (square * off).sum()
                total = _merged_moments(total, block)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.ravel().tolist()])],
                                         names=["task", "moments"])

    tasks = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(
        run, "task int, moments array<double>").collect()
    total = np.zeros((4, len(columns)))
    with np.errstate(all="ignore"):
        for r in sorted(tasks, key=lambda r: r["task"]):
            total = _merged_moments(total, np.array(r["moments"]).reshape(4, -1))
    return {c: (int(total[0, i]), *(float(x) for x in total[1:, i])) for i, c in enumerate(columns)}


def profile_frame(spark, prof: dict) -> DataFrame:
    rows = [(c, p["var_samp"], p["skewness"], p["q1"], p["median"], p["q3"], p["lower"], p["upper"],
             (p["var_samp"] == 0) if p["var_samp"] is not None else None) for c, p in prof.items()]
    return spark.createDataFrame(rows, "feature STRING, var_samp DOUBLE, skewness DOUBLE, q1 DOUBLE, "
                                       "median DOUBLE, q3 DOUBLE, lower DOUBLE, upper DOUBLE, "
                                       "zero_variance BOOLEAN")


def zero_variance(df: DataFrame, columns: list[str]) -> list[str]:
    """A1: columns whose sample variance is exactly 0 (one aggregation)."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"v{i}")
                   for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"v{i}"] == 0]


# ------------------------------------------------------------------ A4 - A6
def outlier_mask(c: str, p: dict) -> Column:
    x = F.col(c)
    return (x < F.lit(p["lower"])) | (x > F.lit(p["upper"]))


def effective_method(p: dict, method: str) -> str:
    """A4 rule: |skew| > 1 forces the median treatment whatever the method."""
    s = p.get("skewness")
    return "median" if s is not None and abs(s) > 1 else method


def apply_outliers(df: DataFrame, prof: dict, method: str = "median") -> DataFrame:
    """A4 (median) / A5 (cap) for independent columns: one projection.

    Rows are kept; outlying cells become the column median or are clipped to
    the fence.  ``remove`` is order-dependent and handled by
    ``remove_outliers``.
    """
    exprs = []
    for c in df.columns:
        p = prof.get(c)
        if p is None or p["lower"] is None:
            exprs.append(F.col(c))
            continue
        m = effective_method(p, method)
        if m == "median":
            exprs.append(F.when(outlier_mask(c, p), F.lit(p["median"])).otherwise(F.col(c)).alias(c))
        elif m == "cap":
            exprs.append(F.least(F.greatest(F.col(c), F.lit(p["lower"])), F.lit(p["upper"])).alias(c))
        else:
            raise ValueError(f"method {m!r} is not a per-cell treatment")
    return df.select(*exprs)


def remove_outliers(df: DataFrame, columns: list[str], checkpoint_every: int = 4) -> DataFrame:
    """Column by column, refit on the table left by earlier columns and
    drop its outlier rows; a skewed column (|g1| > 1) takes the median
    treatment instead (rows kept).  Lineage is cut with a reliable
    checkpoint every few columns so the plan does not grow with p."""
    from quire.session import cut_lineage
    out = df
    for i, c in enumerate(columns):
        p = profile(out, [c])[c]
        if p["lower"] is None:
            continue
        if effective_method(p, "remove") == "median":
            out = out.withColumn(c, F.when(outlier_mask(c, p), F.lit(p["median"])).otherwise(F.col(c)))
        else:
            out = out.where(~outlier_mask(c, p) | F.col(c).isNull())
        if checkpoint_every and (i + 1) % checkpoint_every == 0:
            out = cut_lineage(out)
    return out


# ------------------------------------------------------------------ A7 - A10
def fit_scaler(df: DataFrame, columns: list[str], moments: dict | None = None) -> dict:
    """Mean and population std per column; std 0 -> scale 1.  ``moments``: those of ``column_moments``, if known."""
    if moments is not None:
        return {c: {"mean": mean if n else None, "scale": (math.sqrt(m2 / n) if n else None) or 1.0} for c, (n, mean, m2, _) in moments.items()}
    row = df.agg(*[x for i, c in enumerate(columns)
                   for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return {c: {"mean": row[f"m{i}"], "scale": (row[f"s{i}"] if row[f"s{i}"] else 1.0)}
            for i, c in enumerate(columns)}


def apply_scaler(df: DataFrame, params: dict, round_digits: int | None = None) -> DataFrame:
    """A8 (+A10): (x - mean) / scale, optionally numpy-rounded (half-even)."""
    exprs = []
    for c in df.columns:
        if c in params:
            e = (F.col(c) - F.lit(params[c]["mean"])) / F.lit(params[c]["scale"])
            if round_digits is not None:
                e = round_half_even(e, round_digits)
            exprs.append(e.alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def scaler_frame(spark, params: dict) -> DataFrame:
    return spark.createDataFrame([(c, float(p["mean"]), float(p["scale"])) for c, p in params.items()],
                                 "feature STRING, mean DOUBLE, scale DOUBLE")


# ------------------------------------------------------------------ A11 - A13
def _long(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, x, y) rows; the explode feeds map-side partial aggregation
    in the same stage, so only compressed cells cross the shuffle."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                    for c in features])
    return (df.select(F.col(target).cast("double").alias("y"), F.explode(arr).alias("s"))
            .select("s.feature", "s.x", "y")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))


def pearson_vs_target(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson r of each feature with the target; NULL when either
    population std is 0 (``corr`` would raise under ANSI)."""
    aggs = []
    for i, c in enumerate(features):
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"sx{i}"),
                 F.stddev_pop(y).alias(f"sy{i}")]
    a = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"),
                     F.when((F.col(f"sx{i}") > 0) & (F.col(f"sy{i}") > 0),
                            F.col(f"c{i}") / (F.col(f"sx{i}") * F.col(f"sy{i}"))).alias("pearson"))
            for i, c in enumerate(features)]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def midranks(counts: DataFrame, part: str, value: str, n: str = "n", part_rows: int = PART_ROWS) -> DataFrame:
    """Exact average ranks of distinct values within each ``part``.

    ``counts`` holds one row per (part, value) with its multiplicity ``n``; the running
    counts go by ranges of bounded size, so no task holds a whole column.
    Rank = (#rows with smaller value) + (n + 1) / 2.
    """
    return prefix_sums(counts, [part], value, [n], part_rows).withColumnRenamed(f"{n}_below", "below").withColumn(
        "rank", F.col("below") + (F.col(n) + 1) / 2.0)


def spearman_vs_target(df: DataFrame, features: list[str], target: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Spearman rho (average ranks on ties) of each feature with the
    target, computed as the weighted Pearson r of mid-ranks over the
    compressed (feature, x, y, count) cells."""
    cells = cut_lineage(_long(df, features, target).groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    xr = midranks(cells.groupBy("feature", "x").agg(F.sum("n").alias("n")), "feature", "x",
                  part_rows=part_rows).select("feature", "x", F.col("rank").alias("rx"))
    yr = midranks(cells.groupBy("feature", "y").agg(F.sum("n").alias("n")), "feature", "y", part_rows=part_rows).select(
        "feature", "y", F.col("rank").alias("ry"))
    j = cells.join(xr, ["feature", "x"]).join(yr, ["feature", "y"])
    n = F.sum("n")
    sx, sy = F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxx, syy = F.sum(F.col("n") * F.col("rx") * F.col("rx")), F.sum(F.col("n") * F.col("ry") * F.col("ry"))
    sxy = F.sum(F.col("n") * F.col("rx") * F.col("ry"))
    g = j.groupBy("feature").agg(n.alias("N"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"),
                                 syy.alias("syy"), sxy.alias("sxy"))
    cov = F.col("sxy") / F.col("N") - (F.col("sx") / F.col("N")) * (F.col("sy") / F.col("N"))
    vx = F.col("sxx") / F.col("N") - F.pow(F.col("sx") / F.col("N"), 2)
    vy = F.col("syy") / F.col("N") - F.pow(F.col("sy") / F.col("N"), 2)
    return g.select("feature", F.when((vx > 1e-12) & (vy > 1e-12),
                                      cov / F.sqrt(vx * vy)).alias("spearman"))


def correlation_table(df: DataFrame, features: list[str], target: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(feature, pearson, spearman); constant features get NULLs.
    Callers order with ``orderBy(desc_nulls_last('pearson'), 'feature')``."""
    p = pearson_vs_target(df, features, target)
    s = spearman_vs_target(df, features, target, part_rows)
    return p.join(s, "feature", "left").select(
        "feature", "pearson", F.when(F.col("pearson").isNotNull(), F.col("spearman")).alias("spearman"))


# ------------------------------------------------------------------ A14 - A16
#: Partial results of this many tasks meet in one group of the first merge.
MERGE_FAN = 256
_PARTIAL = "task BIGINT, i INT, n ARRAY<DOUBLE>, mean ARRAY<DOUBLE>, co ARRAY<DOUBLE>"


def _block_moments(x: np.ndarray, present: np.ndarray) -> np.ndarray:
    """(3, p, p) of a block of rows: the number of rows that have both columns, the mean of the first
    over them, the sum of products of deviations from these means."""
    one = present.astype(float)
    n = one.T @ one
    shift = np.where(present, x, 0.0).sum(axis=0) / np.maximum(np.diag(n), 1.0)
    x = np.where(present, x - shift, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, (x.T @ one) / n, 0.0)
        co = x.T @ x - n * mean * mean.T
    return np.stack([n, np.where(n > 0, mean + shift[:, None], 0.0), co])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two disjoint sets of rows taken together, entry by entry."""
    (na, ma, ca), (nb, mb, cb) = a, b
    both, n = (na > 0) & (nb > 0), na + nb
    gap = np.where(both, mb - ma, 0.0)  # an empty side has mean 0 and must not move the other's
    share = nb / np.maximum(n, 1.0)
    return np.stack([n, np.where(na > 0, ma + gap * share, mb), ca + cb + gap * gap.T * na * share])


def _task_moments(columns: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if not batch.num_rows or not columns:
                continue
            cols = [batch.column(k) for k in range(len(columns))]
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]).astype(float)
            present = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in cols])
            block = _block_moments(x, present)
            total = block if total is None else _merged(total, block)
        if total is not None:
            yield _packed(pa, TaskContext.get().partitionId(), total)
    return run


def _packed(pa, task: int, m: np.ndarray):
    """Moments as a record batch: the whole matrix in one row (``i`` is its width)."""
    p = m.shape[1]
    return pa.RecordBatch.from_pydict(
        {"task": pa.array([task], pa.int64()), "i": pa.array([p], pa.int32()),
         **{k: pa.array([m[j].ravel()], pa.list_(pa.float64())) for j, k in enumerate(("n", "mean", "co"))}})


def _merge_moments(table):
    import pyarrow as pa

    total = None
    for row in table.sort_by("task").to_batches(max_chunksize=1):
        p = row.column("i")[0].as_py()
        m = np.stack([row.column(k).flatten().to_numpy().reshape(p, p) for k in ("n", "mean", "co")])
        total = m if total is None else _merged(total, m)
    return pa.Table.from_batches([_packed(pa, table.column("task")[0].as_py() // MERGE_FAN, total)])


def gram(df: DataFrame, features: list[str]) -> dict:
    """One pass: n, means, sample covariances and raw cross products for all pairs.

    A task takes its rows in Arrow batches, a batch by two matrix products, and gives one
    row of 3 p^2 numbers; these meet in groups of ``MERGE_FAN`` tasks, then in one.  The
    plan does not grow with p.  A null leaves its row out of the pairs of its column only; a NaN
    or an infinity makes all pairs of its column NaN.  Deviations are taken from the means of the
    rows at hand, so large means lose no digits.
    """
    p = len(features)
    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]).mapInArrow(
        _task_moments(list(features)), _PARTIAL)
    once = parts.withColumn("at", F.floor(F.col("task") / MERGE_FAN)).groupBy("at").applyInArrow(
        _merge_moments, _PARTIAL)
    row = once.withColumn("at", F.lit(0)).groupBy("at").applyInArrow(_merge_moments, _PARTIAL).first() if p else None
    n, mean, co = ((np.array(row[k]).reshape(p, p) for k in ("n", "mean", "co")) if row
                   else (np.zeros((p, p)) for _ in range(3)))
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = np.where(n > 1, co / (n - 1), np.nan)
        raw = co + n * mean * mean.T
        own = np.where(np.diag(n) > 0, np.diag(mean), np.nan)
    return {"n": int(np.diag(n).max()) if p else 0, "mean": own, "cov": cov, "raw": raw, "features": list(features)}


def corr_from_gram(g: dict) -> np.ndarray:
    d = np.sqrt(np.diag(g["cov"]))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = g["cov"] / np.outer(d, d)
    r[~np.isfinite(r)] = np.nan
    return r


def pearson_matrix(spark, df: DataFrame, features: list[str]) -> DataFrame:
    """Long-form (feature_i, feature_j, r) from one Gram pass."""
    r = corr_from_gram(gram(df, features))
    rows = [(a, b, None if math.isnan(r[i, j]) else float(r[i, j]))
            for i, a in enumerate(features) for j, b in enumerate(features)]
    return spark.createDataFrame(rows, "feature_i STRING, feature_j STRING, r DOUBLE")


def _inv_diag(m: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Diagonal of the inverse of a p x p Gram or correlation matrix.

    Where columns are dependent, 1 / residual share of each column against
    the others is still finite for the columns that take no part in the
    dependence; those that do, and columns without variance, are NaN."""
    out = np.full(m.shape[0], np.nan)
    scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), np.nan))
    ok = np.nonzero(np.isfinite(scale) & np.isfinite(np.diag(m)))[0]
    ok = ok[np.isfinite(m[np.ix_(ok, ok)]).all(axis=1)]
    unit = m[np.ix_(ok, ok)] / np.outer(scale[ok], scale[ok])
    for i in range(len(ok)):
        rest = [j for j in range(len(ok)) if j != i]
        # what the other columns leave unexplained; their own dependence does not matter to lstsq
        part = np.linalg.lstsq(unit[np.ix_(rest, rest)], unit[rest, i], rcond=tol)[0] if rest else np.zeros(0)
        left = 1.0 - unit[i, rest] @ part
        if left > tol:
            out[ok[i]] = 1.0 / (left * m[ok[i], ok[i]])
    return out


def vif_from_gram(g: dict, subset: list[str] | None = None, intercept: bool = True) -> list[tuple]:
    """A15 (centred, with intercept): VIF_i = [R^-1]_ii.  A16 (no
    intercept, uncentred R^2): VIF_i = [G^-1]_ii * G_ii with G = X'X.

    Subsets are sub-matrices of the one Gram, so selection loops never
    rescan the data.  Exactly dependent columns get (vif NULL, collinear
    True); the others keep their finite values."""
    feats = g["features"]
    idx = [feats.index(f) for f in (subset or feats)]
    if intercept:
        m = corr_from_gram(g)[np.ix_(idx, idx)]
        vif = _inv_diag(m)
    else:
        m = g["raw"][np.ix_(idx, idx)]
        vif = _inv_diag(m) * np.diag(m)
    out = []
    for k, i in enumerate(idx):
        v = vif[k]
        bad = not np.isfinite(v)
        out.append((feats[i], None if bad else float(v), bool(bad)))
    return out


def vif(spark, df: DataFrame, features: list[str], intercept: bool = True) -> DataFrame:
    rows = vif_from_gram(gram(df, features), intercept=intercept)
    return spark.createDataFrame(rows, "feature STRING, vif DOUBLE, collinear BOOLEAN")


# ------------------------------------------------------------------ A17
def class_balance(df: DataFrame, target: str, severe_below: float = 0.2) -> DataFrame:
    """Per class count and percent, plus min/max ratio and a severe flag
    (ratio < 0.2).  One aggregation; the totals come from a window over the
    handful of class rows."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return c.select(
        F.col(target).alias("class"), "n",
        (F.col("n") * 100.0 / F.sum("n").over(w)).alias("percent"),
        (F.min("n").over(w) / F.max("n").over(w)).alias("balance_ratio"),
        ((F.min("n").over(w) / F.max("n").over(w)) < severe_below).alias("severe"))
