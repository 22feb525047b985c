"""Column expressions shared by the operators (all JVM-side built-ins).

Everything here returns a ``Column`` so it folds into one whole-stage-codegen
projection; no Python UDF is involved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python ``int(s)`` on a string: optional surrounding whitespace, optional
# sign, ASCII digits.  Used identically by the SQL oracle, because engine
# casts disagree ('3.7' casts to 4 in one engine and fails in Python).
INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_text(c) -> Column:
    """String -> INT with Python ``int()`` acceptance, else NULL."""
    c = col_(c)
    return F.when(c.rlike(INT_TEXT), F.trim(c).try_cast("int"))


def finite_or_null(c) -> Column:
    """NaN and +-inf become NULL (the library's only missing marker)."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def finite_sql(c: str) -> str:
    """SQL text of ``finite_or_null`` for column ``c``."""
    return (f"CASE WHEN isnan(`{c}`) OR abs(`{c}`) = CAST('Infinity' AS DOUBLE) THEN NULL"
            f" ELSE `{c}` END")


def safe_div(a, b) -> Column:
    return F.try_divide(col_(a), col_(b))


def row_sum(cols) -> Column:
    """Row sum skipping NULLs (pandas ``sum(axis=1)``)."""
    return reduce(lambda x, y: x + y, [F.coalesce(col_(c).cast("double"), F.lit(0.0)) for c in cols])


def row_count(cols) -> Column:
    return reduce(lambda x, y: x + y, [col_(c).isNotNull().cast("int") for c in cols])


def row_mean(cols) -> Column:
    """Row mean over non-NULL cells; NULL when all are NULL."""
    return safe_div(row_sum(cols), row_count(cols).cast("double"))


def row_var_samp(cols) -> Column:
    """Row sample variance (ddof=1) over non-NULL cells, NULL when < 2 cells."""
    n = row_count(cols).cast("double")
    mean = row_mean(cols)
    ss = reduce(lambda x, y: x + y,
                [F.coalesce(F.pow(col_(c).cast("double") - mean, 2), F.lit(0.0)) for c in cols])
    return F.when(n >= 2, safe_div(ss, n - 1))


def count_equal(cols, value) -> Column:
    return reduce(lambda x, y: x + y, [F.coalesce((col_(c) == value).cast("double"), F.lit(0.0))
                                       for c in cols])


def round_half_even(c, digits: int = 3) -> Column:
    """numpy ``round`` (banker's rounding on the scaled value): rint(x*10^d)/10^d."""
    scale = float(10 ** digits)
    return F.rint(col_(c) * scale) / scale


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)
