"""Response screening (C1) and approval (C6): per-row array expressions.

Input is a ``MAP<group, ARRAY<value>>`` column (P25, P26 or P29); groups
are visited in the order given (spec order), answers concatenated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.spec import SCREEN_MEAN, SCREEN_VARIANCE, SCREEN_Z


def screen(groups: Column, order: list[str]) -> Column:
    """STRUCT(screening_passed BOOLEAN, screening_msg STRING).

    Rules in order: empty map; per group: missing/empty list, non-integer,
    outside 1..3; all identical; z-test of the mean against 2 with sd
    sqrt(2/3) (fail when |z| > 1.96, message ``z=%.2f``); otherwise the
    share of each value, ``k (pct%)`` sorted by k, pct truncated.
    """
    checks = [F.when(F.size(F.map_keys(groups)) == 0, F.lit("Empty answers dictionary"))]
    numbers = {g: F.transform(groups[g], lambda x: x.cast("string").try_cast("double")) for g in order}
    for g in order:
        v = numbers[g]
        checks += [
            F.when(v.isNull() | (F.size(v) == 0), F.lit(f"Invalid or empty list for {g}")),
            F.when(~F.forall(v, lambda x: x.isNotNull()), F.lit(f"Non-integer values in {g}")),
            F.when(~F.forall(v, lambda x: (F.floor(x) >= 1) & (F.floor(x) <= 3)),
                   F.lit(f"Values in {g} must be between 1 and 3")),
        ]
    vals = F.flatten(F.array(*[F.coalesce(numbers[g], F.array().cast("array<double>")) for g in order]))
    ints = F.transform(vals, lambda x: F.floor(x).cast("int"))
    n = F.size(ints)
    total = F.aggregate(ints, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    mean = total.cast("double") / n.cast("double")
    se = math.sqrt(SCREEN_VARIANCE) / F.sqrt(n.cast("double"))
    z = (mean - F.lit(SCREEN_MEAN)) / se
    checks += [
        F.when(n == 0, F.lit("No valid answers found")),
        F.when(F.size(F.array_distinct(ints)) == 1, F.lit("All answers identical")),
        F.when(F.abs(z) > SCREEN_Z, F.format_string("Anomalous score detected (z=%.2f)", z)),
    ]
    fail = F.coalesce(*checks)
    counts = F.transform(F.array_sort(F.array_distinct(ints)), lambda k: F.concat(
        k.cast("string"), F.lit(" ("),
        ((F.size(F.filter(ints, lambda x: x == k)).cast("double") / n.cast("double")) * 100)
        .cast("int").cast("string"), F.lit("%)")))
    ok_msg = F.array_join(counts, ", ")
    return F.struct(fail.isNull().alias("screening_passed"),
                    F.coalesce(fail, ok_msg).alias("screening_msg"))


def approval(screening_passed: Column, model_prediction: Column) -> Column:
    """Approved iff screening passed and the model class is 0."""
    return F.when(screening_passed & (model_prediction == 0), F.lit("approved")).otherwise(
        F.lit("rejected"))
