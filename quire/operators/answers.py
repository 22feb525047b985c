"""Answer arrays -> wide rows (P3-P6) and scoring payload handling.

All parsing is done in place with higher-order array functions, one row at
a time, so there is no explode and no shuffle: the stage is a narrow map
over the scan and partitions exactly like its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.exprs import INT_TEXT, all_of, finite_or_null
from quire.spec import SurveySpec


def _valid_items(answer: Column) -> Column:
    """P3 item guard: keep items carrying group, questionNumber and choiceNumber
    that parse as Python ints; others are skipped, not fatal.  Items become
    (group, q INT, choice INT), array order preserved."""
    ok = F.filter(answer, lambda x: x["group"].isNotNull()
                  & x["questionNumber"].rlike(INT_TEXT)
                  & x["choiceNumber"].rlike(INT_TEXT))
    return F.transform(ok, lambda x: F.struct(
        x["group"].alias("group"),
        F.trim(x["questionNumber"]).try_cast("int").alias("q"),
        F.trim(x["choiceNumber"]).try_cast("int").alias("choice")))


def _last_for(items: Column, number: int) -> Column:
    """Last item answering question ``number`` (dict overwrite = last wins)."""
    return F.try_element_at(F.filter(items, lambda x: x["q"] == number), F.lit(-1))


def parse_answers(df: DataFrame, spec: SurveySpec, answer_col: str = "answer",
                  keep: tuple = ()) -> DataFrame:
    """P3+P4+P5: parse every row; add the wide columns and ``reject_reason``.

    ``reject_reason`` is NULL for accepted rows; otherwise the first failing
    rule in the reference's order: not a list, too few items, then per
    mapped question in spec order: missing, or answered in another group.
    Expressions are SQL text (no shuffle).  A row's items are read
    once into one struct: a lambda over a one-element array binds what several
    rules look at.  ``inline`` gives exactly one row of that struct; a filter on ``reject_reason`` cannot
    be moved below it, so the row that passes is not parsed a second time for its columns.
    """
    a = f"`{answer_col}`"
    pat = INT_TEXT.replace("\\", "\\\\")
    items = (f"transform(filter({a}, x -> x.`group` IS NOT NULL AND x.questionNumber RLIKE '{pat}'"
             f" AND x.choiceNumber RLIKE '{pat}'), x -> named_struct('group', x.`group`,"
             f" 'q', try_cast(trim(x.questionNumber) AS INT), 'choice', try_cast(trim(x.choiceNumber) AS INT)))")
    numbers = ", ".join(str(q.number) for q in spec.questions)
    picks = (f"transform(array({items}), i -> transform(array({numbers}),"
             f" n -> try_element_at(filter(i, x -> x.q = n), -1)))[0]")
    checks = [f"CASE WHEN {a} IS NULL THEN 'answer is not a list' END",
              f"CASE WHEN size({a}) < {spec.min_items} THEN 'fewer than {spec.min_items} items' END"]
    for k, q in enumerate(spec.questions):
        checks.append(f"CASE WHEN p[{k}] IS NULL THEN 'missing question {q.number}'"
                      f" WHEN p[{k}].`group` <> '{q.group}' THEN 'group mismatch at question {q.number}' END")
    parsed = (f"transform(array({picks}), p -> named_struct('_choices', transform(p, y -> y.choice),"
              f" '_reason', coalesce({', '.join(checks)})))")
    keep_cols = [f"`{c}`" for c in df.columns if c != answer_col] + [f"`{c}`" for c in keep]
    return df.selectExpr("*", f"inline({parsed})").selectExpr(
        *keep_cols, *[f"_choices[{k}] AS `{q.column}`" for k, q in enumerate(spec.questions)],
        "_reason AS reject_reason")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame, key: str = "user_id") -> DataFrame:
    """P5 side output: one row per rejected input with its reason."""
    return parsed.where(F.col("reject_reason").isNotNull()).select(key, "reject_reason")


def fill_int(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN/+-inf/NULL -> 0 and cast to BIGINT."""
    exprs = []
    for c in df.columns:
        if c in columns:
            dt = dict(df.dtypes)[c]
            v = finite_or_null(F.col(c)) if dt in ("double", "float") else F.col(c)
            exprs.append(F.coalesce(v, F.lit(0)).cast("bigint").alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


# ---------------------------------------------------------------------------
# Scoring payloads: ARRAY<STRUCT<group, item, version STRING, choiceNumber INT>>
# ---------------------------------------------------------------------------

def select_answers(payload: Column, selector: list[dict]) -> Column:
    """P25: for each ``{group, version}`` keep matching items, order by
    int(item), return ``MAP<group, ARRAY<choice>>``; empty groups omitted.
    Of several entries for one group the last with items wins."""
    entries: dict = {}
    for sel in selector:
        g, v = sel["group"], sel["version"]
        picked = F.filter(payload, lambda x: (x["group"] == g) & (x["version"] == v))
        # stable sort on int(item): arrival position breaks ties
        ordered = F.array_sort(F.transform(picked, lambda x, i: F.struct(
            F.trim(x["item"]).try_cast("int").alias("k"), i.alias("pos"),
            x["choiceNumber"].alias("c"))))
        choices = F.transform(ordered, lambda x: x["c"])
        entry = F.when(F.size(choices) > 0, F.struct(F.lit(g).alias("key"), choices.alias("value")))
        entries[g] = F.coalesce(entry, entries[g]) if g in entries else entry
    if not entries:
        return F.create_map().cast("map<string,array<int>>")
    arr = F.filter(F.array(*entries.values()), lambda e: e.isNotNull())
    return F.map_from_entries(arr)


def group_answers_expr(payload_col: str = "answers") -> str:
    """P26 as one SQL expression: ``MAP<group, ARRAY<choice>>`` over every
    non-empty group (version ignored).  Items are sorted by numeric ``item``
    (non-digit -> 0) with arrival order as the stable tie-break; a missing
    choice is 0.  A respondent's payload is one row, so grouping happens in
    place: no explode, no shuffle."""
    p = f"`{payload_col}`"
    valid = (f"filter(transform({p}, (x, i) -> named_struct('g', x.`group`,"
             f" 'k', CASE WHEN x.item RLIKE '^[0-9]+$' THEN try_cast(x.item AS BIGINT) ELSE 0L END,"
             f" 'pos', i, 'c', coalesce(x.choiceNumber, 0))), y -> y.g IS NOT NULL AND y.g <> '')")
    return (f"map_from_entries(transform(array_distinct(transform({valid}, y -> y.g)),"
            f" g -> named_struct('key', g, 'value',"
            f" transform(array_sort(filter({valid}, y -> y.g = g)), z -> z.c))))")


def group_answers(df: DataFrame, payload_col: str = "answers", key: str = "resp_id") -> DataFrame:
    """P26 in long form: one row per (respondent, group) with its sorted
    choices (a narrow map explode of ``group_answers_expr``)."""
    return (df.selectExpr(f"`{key}`", f"{group_answers_expr(payload_col)} AS _m")
            .selectExpr(f"`{key}`", "explode(_m) AS (`group`, choices)"))


def validate_payload(groups: Column, required: tuple) -> Column:
    """Reason string (NULL = valid) for a ``MAP<group, ARRAY<...>>``.

    Required groups present; every value is a non-negative integer text
    (a NULL choice is not).
    """
    checks = [F.when(~F.array_contains(F.map_keys(groups), g), F.lit(f"missing required key {g}"))
              for g in required]
    checks += [F.when(~F.forall(groups[g], lambda x: F.coalesce(x.cast("string").rlike("^[0-9]+$"), F.lit(False))),
                      F.lit(f"invalid values in {g}")) for g in required]
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def payload_to_wide(groups: Column, spec: SurveySpec) -> list[Column]:
    """``fht{i+1}`` = i-th choice of group fht (1-based element access)."""
    out = []
    for q in spec.questions:
        idx = int(q.column[len(q.group):])
        out.append(F.try_element_at(groups[q.group], F.lit(idx)).cast("int").alias(q.column))
    return out


def wide_to_groups(spec: SurveySpec, columns: list[str] | None = None) -> Column:
    """Wide row -> ``MAP<stem, ARRAY<value>>`` by exact stem (trailing
    digits stripped), columns in spec order."""
    cols = columns or spec.columns
    stems: dict[str, list[str]] = {}
    for c in cols:
        stems.setdefault(c.rstrip("0123456789"), []).append(c)
    args = []
    for s, cs in stems.items():
        args += [F.lit(s), F.array(*[F.col(c) for c in cs])]
    return F.create_map(*args)


def valid_wide(spec: SurveySpec) -> Column:
    return all_of([F.col(c).isNotNull() for c in spec.columns])
