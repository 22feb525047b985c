"""Row-wise feature engineering (F1-F8): one codegen'd projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.exprs import (count_equal, finite_or_null, finite_sql, row_count, row_mean, row_sum,
                                   row_var_samp, safe_div)
from quire.operators.prepare import NUMERIC_TYPES, apply_fill, fit_impute
from quire.spec import SurveySpec


def group_feature_columns(spec: SurveySpec, present: list[str]) -> list:
    """F1-F4 for every spec group: sum, mean, sample variance (NULL->0), #==3."""
    out = []
    for g, cols in spec.groups.items():
        cs = [c for c in cols if c in present]
        if not cs:
            continue
        out += [row_sum(cs).alias(f"{g}_score_sum"),
                row_mean(cs).alias(f"{g}_score_avg"),
                F.coalesce(row_var_samp(cs), F.lit(0.0)).alias(f"{g}_score_var"),
                count_equal(cs, 3).alias(f"{g}_high_score_count")]
    return out


def _sum_sql(cols) -> str:
    return "(" + " + ".join(f"coalesce(cast(`{c}` as double), 0D)" for c in cols) + ")"


def _n_sql(cols) -> str:
    return "(" + " + ".join(f"cast(`{c}` is not null as int)" for c in cols) + ")"


def group_feature_sql(spec: SurveySpec, present: list[str]) -> list[str]:
    """F1-F4 as SQL expressions: sum (NULL skipped), mean over non-NULL
    cells, sample variance (NULL -> 0), count of cells equal to 3."""
    out = []
    for g, cols in spec.groups.items():
        cs = [c for c in cols if c in present]
        if not cs:
            continue
        s, n = _sum_sql(cs), _n_sql(cs)
        mean = f"try_divide({s}, cast({n} as double))"
        ss = " + ".join(f"coalesce(pow(cast(`{c}` as double) - {mean}, 2), 0D)" for c in cs)
        out += [f"{s} AS `{g}_score_sum`", f"{mean} AS `{g}_score_avg`",
                f"coalesce(CASE WHEN {n} >= 2 THEN try_divide({ss}, cast({n} - 1 as double)) END, 0D)"
                f" AS `{g}_score_var`",
                "(" + " + ".join(f"coalesce(cast(`{c}` = 3 as double), 0D)" for c in cs) + f") AS `{g}_high_score_count`"]
    return out


def engineer(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """F1-F6 in one projection.  Expressions are generated as SQL text, so
    the whole projection is built in one call however many groups the spec
    has; Catalyst folds the repeated sums within the codegen'd stage."""
    present = df.columns
    missing = [c for cols in spec.groups.values() for c in cols if c not in present]
    if missing:
        raise ValueError(f"missing group columns: {missing}")
    ratios = [f"try_divide({_sum_sql(spec.groups[n])}, {_sum_sql(spec.groups[d])} + 1) AS `{name}`"
              for name, n, d in spec.ratios]
    inter = [f"try_divide({_sum_sql(spec.groups[a])}, cast({_n_sql(spec.groups[a])} as double))"
             f" * try_divide({_sum_sql(spec.groups[b])}, cast({_n_sql(spec.groups[b])} as double)) AS `{name}`"
             for name, a, b in spec.interactions]
    return df.selectExpr("*", *group_feature_sql(spec, present), *ratios, *inter)


def categorical_rollup(df: DataFrame, spec: SurveySpec, categorical: list[str] | None = None) -> DataFrame:
    """``{g}_sum`` and ``{g}_count`` (cells > 0) over name-matched columns.

    Default groups are the spec prefixes (``category_`` -> ``category_group``);
    with explicit categorical columns the group of ``c`` is ``c_*``.
    """
    if categorical:
        groups = {f"{c}_group": [x for x in df.columns if x.startswith(f"{c}_")] for c in categorical}
    else:
        groups = {f"{p.rstrip('_')}_group": [x for x in df.columns if x.startswith(p)]
                  for p in spec.rollup_prefixes}
    extra = []
    for g, cols in groups.items():
        if cols:
            extra += [row_sum(cols).alias(f"{g}_sum"),
                      row_count([F.when(F.col(c) > 0, F.lit(1)) for c in cols]).cast("bigint")
                      .alias(f"{g}_count")]
    return df.select("*", *extra) if extra else df


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES and c not in exclude]


def fit_nonfinite_fill(df: DataFrame, exclude=("ust", "user_id")) -> dict:
    """F8 fit: medians of numeric columns that hold NULL/NaN/inf cells."""
    cols = numeric_columns(df, exclude)
    cleaned = df.selectExpr(*[f"{finite_sql(c)} AS `{c}`" if t in ("double", "float") else f"`{c}`"
                              for c, t in df.dtypes if c in cols])
    return fit_impute(cleaned, cols, "median")


def apply_nonfinite_fill(df: DataFrame, fill: dict) -> DataFrame:
    """F8 apply: +-inf/NaN -> NULL -> fitted median."""
    if not fill:
        return df
    types = dict(df.dtypes)
    cleaned = df.selectExpr(*[f"{finite_sql(c)} AS `{c}`"
                              if c in fill and types[c] in ("double", "float") else f"`{c}`"
                              for c in df.columns])
    return apply_fill(cleaned, fill)
