"""Cleaning, recoding and encoding.

Fitted steps are pairs: ``fit_*`` runs one aggregation and returns a small
dict of parameters; ``apply_*`` is a lazy projection/filter using them, so
training and scoring share the same code path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.exprs import all_of, finite_or_null
from quire.functions.prefix import PART, PART_ROWS, lay_out, sums_before
from quire.functions.quantiles import exact_quantiles
from quire.spec import SurveySpec

NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


class DataQualityError(ValueError):
    pass


def dedup_exact(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows over all columns.

    Map-side partial aggregation collapses copies before the shuffle, so
    even a row repeated a billion times costs one record per map task.
    """
    return df.dropDuplicates()


def fit_mode(df: DataFrame, column: str):
    """Most frequent non-NULL value, smallest value on ties."""
    row = (df.where(F.col(column).isNotNull()).groupBy(column).count()
           .orderBy(F.desc("count"), F.asc(column)).limit(1).collect())
    return row[0][0] if row else None


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill NULLs of each column with its fitted value (no-op when None)."""
    todo = {c: v for c, v in values.items() if v is not None and c in df.columns}
    if not todo:
        return df
    return df.select(*[F.coalesce(F.col(c), F.lit(todo[c])).alias(c) if c in todo else F.col(c)
                       for c in df.columns])


def target_domain(df: DataFrame, target: str = "ust", domain=(0, 1)) -> DataFrame:
    """Keep rows whose target is in the domain; cast to INT."""
    return (df.where(F.col(target).isin(*domain))
            .withColumn(target, F.col(target).cast("int")))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """To DOUBLE; unparsable text -> NULL; NaN/inf -> NULL."""
    def conv(c):
        v = f"try_cast(`{c}` AS DOUBLE)"
        return (f"CASE WHEN isnan({v}) OR abs({v}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {v} END"
                f" AS `{c}`")
    return df.selectExpr(*[conv(c) if c in columns else f"`{c}`" for c in df.columns])


def fit_impute(df: DataFrame, columns: list[str], method: str = "median",
               only_if_null: bool = True) -> dict:
    """Per-column fill values.

    ``median`` is exact (``exact_quantiles``); any other method means the
    mean.  With ``only_if_null`` a cheap NULL-count
    pass runs first and the median pass covers only columns that need it.
    """
    if not columns:
        return {}
    cols = columns
    if only_if_null:
        nulls = df.agg(*[F.expr(f"count_if(`{c}` IS NULL)").alias(c) for c in columns]).first()
        cols = [c for c in columns if nulls[c] > 0]
        if not cols:
            return {}
    if method == "median":
        return {c: q[0] for c, q in exact_quantiles(df, cols, (0.5,)).items()}
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: (None if row[c] is None else float(row[c])) for c in cols}


def recode(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Ordinal recode; rows with any value outside the map (NULL too)
    are dropped.  One predicate and one projection for all columns."""
    cols = [c for c in spec.recode if c in df.columns]
    keep = all_of([F.col(c).isin(*spec.recode[c].keys()) for c in cols])

    def mapped(c: str) -> Column:
        m = spec.recode[c]
        e = None
        for k, v in m.items():
            e = (F.when(F.col(c) == k, F.lit(float(v))) if e is None
                 else e.when(F.col(c) == k, F.lit(float(v))))
        return e.alias(c)

    return df.where(keep).select(*[mapped(c) if c in cols else F.col(c) for c in df.columns])


def fit_categories(df: DataFrame, columns: list[str], max_levels: int | None = None) -> dict:
    """Vocabulary per categorical column (NULL -> 'missing'), sorted.

    P17's output is as wide as the vocabulary, so it is held on the driver.
    A caller that wants a limit sets ``max_levels``; it is then checked
    before anything is collected.
    """
    out = {}
    for c in columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        if max_levels is not None:
            n = df.agg(F.count_distinct(v)).first()[0]
            if n > max_levels:
                raise DataQualityError(f"{c}: {n} levels exceed max_levels={max_levels}")
        out[c] = sorted(r[0] for r in df.select(v.alias("v")).distinct().collect())
    return out


def apply_onehot(df: DataFrame, vocab: dict) -> DataFrame:
    """``{col}_{value}`` DOUBLE indicator per level, in sorted level
    order, source column dropped.  Levels unseen at fit time are all-zero."""
    exprs = []
    for c in df.columns:
        if c in vocab:
            v = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
            exprs += [F.when(v == lvl, 1.0).otherwise(0.0).alias(f"{c}_{lvl}") for lvl in vocab[c]]
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def fit_labels(df: DataFrame, column: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The dictionary ``level, code`` of a column (NULL -> 'missing'), codes 0..k-1 in sorted order.

    Levels are numbered inside ranges of about ``part_rows`` and shifted by what
    lies in earlier ranges, so a column may have any number of levels; none reaches the driver.
    """
    levels = df.select(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("level")).distinct()
    laid = lay_out(levels, ["level"], part_rows)
    before = sums_before(laid.groupBy(PART).agg(F.count(F.lit(1)).alias("n")), [], ["n"])
    inside = F.row_number().over(Window.partitionBy(PART).orderBy("level"))
    return laid.join(before, PART).select("level", (F.col("n") + inside - 1).cast("bigint").alias("code"))


def apply_labels(df: DataFrame, dictionaries: dict) -> DataFrame:
    """Each column of ``dictionaries`` becomes its level's code (BIGINT); NULL for a level unseen at fit time.

    Left joins; whether a dictionary is broadcast is left to Spark's byte threshold."""
    out = df
    for i, (c, levels) in enumerate(dictionaries.items()):
        level, code = f"_level{i}", f"_code{i}"
        v = F.coalesce(F.col(c).cast("string"), F.lit("missing"))
        out = out.join(levels.select(F.col("level").alias(level), F.col("code").alias(code)), v == F.col(level), "left")
    codes = {c: f"_code{i}" for i, c in enumerate(dictionaries)}
    return out.select(*[F.col(codes[c]).alias(c) if c in codes else F.col(c) for c in df.columns])


def prune_suffixes(df: DataFrame, suffixes=("_sum", "_count", "_var")) -> DataFrame:
    """P20: drop columns whose name ends with any suffix."""
    return df.select(*[c for c in df.columns if not c.endswith(tuple(suffixes))])


def quality_report(df: DataFrame, name: str = "frame", min_rows: int = 1, min_cols: int = 1,
                   target: str | None = None, allow_categorical: bool = True,
                   required: list[str] | None = None) -> DataFrame:
    """Every rule of the data-quality gate in ONE aggregation.

    Returns (check, passed, detail) rows, lazily; ``enforce`` turns
    a failure into an exception.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)]
    has_target = target is not None and target in cols
    if has_target:
        aggs.append(F.count_distinct(F.col(target)).alias("_nt"))
    a = df.agg(*aggs)
    any_value = F.array_max(F.array(*[F.col(f"_nn{i}") for i in range(len(cols))])) if cols else F.lit(0)
    types = dict(df.dtypes)
    non_numeric = [c for c in cols if c != target and types[c] not in NUMERIC_TYPES]
    missing = [f for f in (required or []) if f not in cols]
    checks = [
        ("non_empty", F.col("_n") > 0, F.concat(F.lit("rows="), F.col("_n").cast("string"))),
        ("min_rows", F.col("_n") >= min_rows, F.concat(F.lit(f"min={min_rows} rows="),
                                                      F.col("_n").cast("string"))),
        ("min_cols", F.lit(len(cols) >= min_cols), F.lit(f"min={min_cols} cols={len(cols)}")),
        ("not_all_null", any_value > 0, F.lit("")),
        ("target_present", F.lit(target is None or has_target), F.lit(target or "")),
        ("target_two_classes", (F.col("_nt") >= 2) if has_target else F.lit(target is None),
         F.col("_nt").cast("string") if has_target else F.lit("")),
        ("numeric_only", F.lit(allow_categorical or not non_numeric), F.lit(",".join(non_numeric))),
        ("required_features", F.lit(not missing), F.lit(",".join(missing))),
    ]
    return a.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("frame"), F.lit(k).alias("check"), p.alias("passed"),
                 d.alias("detail")) for k, p, d in checks])).alias("r")).select("r.*")


def enforce(df: DataFrame, name: str = "frame", warn: tuple = (), **rules) -> DataFrame:
    """P22 as a gate: the report of ``quality_report(df, name, **rules)``, or ``DataQualityError`` if a rule fails.

    Rules named in ``warn`` are reported and stop nothing.  The report returned
    holds its eight rows and no longer refers to ``df``."""
    report = quality_report(df, name, **rules)
    rows = report.collect()
    bad = [r for r in rows if not r["passed"] and r["check"] not in warn]
    if bad:
        raise DataQualityError("; ".join(f"{r['frame']}.{r['check']} failed ({r['detail']})" for r in bad))
    return df.sparkSession.createDataFrame(rows, report.schema)


def drop_key(df: DataFrame, key: str = "user_id") -> DataFrame:
    """P14 as in the reference (ours keeps the key as a pass-through id)."""
    return df.drop(key)
