"""DuckDB oracle SQL for the registered queries.

Each string runs on the pre-registered parquet views (customer, orders,
lineitem, ...).  Fixture views are rebuilt here as CTEs with the same
definitions as ``quire.sources.fixtures``; the job logic is then written
independently in SQL.  Text is generated from the survey spec so the
column lists stay in step with the library.
"""

from __future__ import annotations

from quire.sources.fixtures import ANSWER_COLUMNS, ANSWER_PRIMES
from quire.spec import FK_V1, TRAINING_SLUG

INT_RE = r"\s*[+-]?[0-9]+\s*"


def _q(name: str) -> str:
    return f'"{name}"'


# --------------------------------------------------------------------- fixtures
def cte_users() -> str:
    return "users AS (SELECT c_custkey AS user_id FROM customer)"


def cte_answers_wide() -> str:
    cols = ",\n  ".join(
        f"CAST(1 + ((c_custkey * {ANSWER_PRIMES[i]} + {1009 * (i + 1)}) % 10007) % 3 AS INTEGER) AS {c}"
        for i, c in enumerate(ANSWER_COLUMNS))
    return (f"answers_wide AS (SELECT c_custkey AS user_id, CAST(c_custkey % 4 AS INTEGER) AS feature_id,\n  "
            f"{cols}\n FROM customer)")


def cte_features() -> str:
    return ("features AS (SELECT * FROM (VALUES (0, 'fsk_v1.0'), (1, 'fsk_v2.0'), (2, 'fsk_v2.0'))"
            " t(feature_id, feature_slug))")


def cte_statuses() -> str:
    return ("loan_summary_statuses AS (SELECT o_custkey AS user_id, "
            "CASE o_orderstatus WHEN 'F' THEN 'npl' WHEN 'O' THEN 'healthy' ELSE 'pending' END AS loan_status, "
            "CAST(CASE WHEN o_orderstatus = 'F' THEN 3 - o_orderkey % 7 ELSE o_orderkey % 11 END AS INTEGER)"
            " AS payoff_score FROM orders)")


def _item(group: str, q: int, choice: str) -> str:
    return (f"{{'group': {group}, 'questionNumber': CAST({q} AS VARCHAR), "
            f"'choiceNumber': CAST({choice} AS VARCHAR)}}")


def _edit(q: int, field: str, value: str) -> str:
    fields = {"group": 'x."group"', "questionNumber": "x.questionNumber",
              "choiceNumber": "x.choiceNumber"}
    fields[field] = f"CAST({value} AS VARCHAR)"
    rebuilt = ("{'group': " + fields["group"] + ", 'questionNumber': " + fields["questionNumber"]
               + ", 'choiceNumber': " + fields["choiceNumber"] + "}")
    return f"list_transform(base, lambda x: CASE WHEN x.questionNumber = '{q}' THEN {rebuilt} ELSE x END)"


def cte_answers() -> str:
    items = []
    for q in range(1, 19):
        if q <= 8:
            items.append(_item("'fht'", q, f"fht{q}"))
        elif q <= 10:
            items.append(_item("'set'", q, f"1 + (user_id + {q}) % 3"))
        else:
            items.append(_item("'kmsi'", q, f"kmsi{q - 10}"))
    base = "[" + ", ".join(items) + "]"
    dup = _item("'fht'", 5, "1 + fht5 % 3")
    case = f"""CASE f
      WHEN 0 THEN NULL
      WHEN 1 THEN list_filter(base, lambda x: x.questionNumber <> '18')
      WHEN 2 THEN {_edit(4, 'questionNumber', 'NULL')}
      WHEN 3 THEN {_edit(6, 'questionNumber', "'x'")}
      WHEN 4 THEN {_edit(2, 'questionNumber', "'3.7'")}
      WHEN 5 THEN {_edit(7, 'questionNumber', "' 7 '")}
      WHEN 6 THEN list_concat(base, [{dup}])
      WHEN 7 THEN {_edit(12, 'group', "'fht'")}
      WHEN 8 THEN {_edit(15, 'questionNumber', "'19'")}
      WHEN 9 THEN {_edit(3, 'choiceNumber', "'0'")}
      WHEN 10 THEN {_edit(13, 'choiceNumber', "'4'")}
      WHEN 11 THEN {_edit(16, 'choiceNumber', 'NULL')}
      WHEN 12 THEN {_edit(1, 'choiceNumber', "'abc'")}
      WHEN 13 THEN {_edit(9, 'group', 'NULL')}
      WHEN 14 THEN list_reverse(base)
      ELSE base END"""
    return (f"answers_base AS (SELECT user_id, feature_id, fht5, CAST(user_id % 50 AS INTEGER) AS f,"
            f"\n  {base} AS base FROM answers_wide),\n"
            f"answers AS (SELECT user_id, feature_id, {case} AS answer FROM answers_base)")


def survey_ctes() -> list[str]:
    return [cte_users(), cte_answers_wide(), cte_features(), cte_statuses(), cte_answers()]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ----------------------------------------------------------------- survey jobs
def cte_load(name: str = "loaded", distinct_status: bool = False) -> str:
    st = ("SELECT user_id, CASE WHEN loan_status = 'npl' THEN 1 WHEN loan_status = 'healthy' THEN 0 END AS ust"
          " FROM loan_summary_statuses WHERE (loan_status IN ('npl') AND payoff_score < 0)"
          " OR (loan_status IN ('healthy') AND payoff_score >= 5)")
    if distinct_status:
        st = f"SELECT DISTINCT * FROM ({st})"
    return (f"{name} AS (SELECT u.user_id, a.feature_id, a.answer, l.ust FROM users u"
            " LEFT JOIN answers a ON a.user_id = u.user_id"
            " LEFT JOIN features f ON f.feature_id = a.feature_id"
            f" LEFT JOIN ({st}) l ON l.user_id = u.user_id"
            f" WHERE f.feature_slug IS NOT NULL AND a.answer IS NOT NULL AND l.ust IS NOT NULL"
            f" AND f.feature_slug = '{TRAINING_SLUG}')")


def cte_parsed(src: str = "loaded", name: str = "parsed", spec=FK_V1) -> str:
    items = (f"list_transform(list_filter(answer, lambda x: x.\"group\" IS NOT NULL"
             f" AND regexp_full_match(x.questionNumber, '{INT_RE}')"
             f" AND regexp_full_match(x.choiceNumber, '{INT_RE}')),"
             " lambda x: {'group': x.\"group\", 'q': CAST(trim(x.questionNumber) AS INTEGER),"
             " 'choice': CAST(trim(x.choiceNumber) AS INTEGER)})")
    picks = ",\n  ".join(f"list_filter(items, lambda x: x.q = {q.number})[-1] AS p_{q.column}"
                         for q in spec.questions)
    checks = ["CASE WHEN answer IS NULL THEN 'answer is not a list' END",
              f"CASE WHEN len(answer) < {spec.min_items} THEN 'fewer than {spec.min_items} items' END"]
    for q in spec.questions:
        checks.append(f"CASE WHEN p_{q.column} IS NULL THEN 'missing question {q.number}'"
                      f" WHEN p_{q.column}.\"group\" <> '{q.group}' THEN 'group mismatch at question {q.number}' END")
    wide = ", ".join(f"p_{q.column}.choice AS {q.column}" for q in spec.questions)
    return (f"{name}_items AS (SELECT *, {items} AS items FROM {src}),\n"
            f"{name}_picks AS (SELECT *,\n  {picks}\n FROM {name}_items),\n"
            f"{name} AS (SELECT user_id, feature_id, ust, {wide},\n  COALESCE({', '.join(checks)}) AS reject_reason"
            f" FROM {name}_picks)")


def _recode_expr(c: str, spec=FK_V1) -> str:
    m = spec.recode[c]
    whens = " ".join(f"WHEN {c} = {k} THEN CAST({v} AS DOUBLE)" for k, v in m.items())
    return f"CASE {whens} END AS {c}"


def cte_wide_features(src: str = "parsed", spec=FK_V1) -> list[str]:
    """W1 after parsing: P6 -> P8 -> P10 -> P15 -> P19 -> F1-F6."""
    cols = spec.columns
    fill = ", ".join(f"CAST(COALESCE({c}, 0) AS BIGINT) AS {c}" for c in cols)
    dom = " AND ".join(f"{c} IN ({', '.join(str(k) for k in spec.recode[c])})" for c in cols)
    rec = ", ".join(_recode_expr(c, spec) for c in cols)
    return [
        f"wide AS (SELECT user_id, {fill}, ust FROM {src} WHERE reject_reason IS NULL)",
        "dedup AS (SELECT DISTINCT * FROM wide)",
        "cleaned AS (SELECT user_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
        + ", CAST(ust AS INTEGER) AS ust FROM dedup WHERE ust IN (0, 1))",
        f"recoded AS (SELECT user_id, {rec}, ust FROM cleaned WHERE {dom})",
        "engineered AS (SELECT *, " + engineer_sql(spec) + " FROM recoded)",
    ]


def _row_sum(cs):
    return "(" + " + ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0)" for c in cs) + ")"


def _row_n(cs):
    return "(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cs) + ")"


def engineer_sql(spec=FK_V1) -> str:
    parts = []
    for g, cs in spec.groups.items():
        s, n = _row_sum(cs), _row_n(cs)
        mean = f"({s} / CAST({n} AS DOUBLE))"
        ss = " + ".join(f"COALESCE(pow(CAST({c} AS DOUBLE) - {mean}, 2), 0.0)" for c in cs)
        parts += [f"{s} AS {g}_score_sum", f"{mean} AS {g}_score_avg",
                  f"COALESCE(CASE WHEN {n} >= 2 THEN ({ss}) / ({n} - 1) END, 0.0) AS {g}_score_var",
                  "(" + " + ".join(f"COALESCE(CAST({c} = 3 AS DOUBLE), 0.0)" for c in cs) + f") AS {g}_high_score_count"]
    for name, a, b in spec.ratios:
        parts.append(f"{_row_sum(spec.groups[a])} / ({_row_sum(spec.groups[b])} + 1) AS {name}")
    for name, a, b in spec.interactions:
        ma = f"({_row_sum(spec.groups[a])} / CAST({_row_n(spec.groups[a])} AS DOUBLE))"
        mb = f"({_row_sum(spec.groups[b])} / CAST({_row_n(spec.groups[b])} AS DOUBLE))"
        parts.append(f"{ma} * {mb} AS {name}")
    return ",\n  ".join(parts)


def feature_ctes(distinct_status: bool = True) -> list[str]:
    return survey_ctes() + [cte_load(distinct_status=distinct_status), cte_parsed()] + cte_wide_features()


# ------------------------------------------------------------------ statistics
LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_sql(table: str = "lineitem", cols=LI_COLS) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS feature, var_samp({c}) AS var_samp,"
            f" avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) AS skewness,"
            f" quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,"
            f" quantile_cont({c}, 0.75) AS q3,"
            f" quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lower,"
            f" quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS upper,"
            f" var_samp({c}) = 0 AS zero_variance"
            f" FROM {table}, (SELECT avg({c}) AS m FROM {table}) mm")
    return "\nUNION ALL\n".join(parts)


def _fence_cte(name: str, src: str, c: str) -> str:
    return (f"{name} AS (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,"
            f" quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi,"
            f" quantile_cont({c}, 0.5) AS med,"
            f" avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) AS sk"
            f" FROM {src}, (SELECT avg({c}) AS m FROM {src}) mm)")


#: Columns of lineitem that hold outliers: two moderately skewed, so that they are clipped or their
#: rows removed, and one with |skewness| > 1, which always takes the median.
CHARGES = {"discount_value": "l_extendedprice * l_discount", "tax_units": "l_quantity * l_tax",
           "unit_discount": "l_extendedprice / l_quantity * l_discount"}


def charges_cte() -> str:
    return ("charges AS (SELECT l_orderkey, l_linenumber, "
            + ", ".join(f"{e} AS {c}" for c, e in CHARGES.items()) + " FROM lineitem)")


def outlier_sql(method: str, cols=LI_COLS, first: tuple = (), table: str = "lineitem") -> str:
    key = "l_orderkey, l_linenumber"
    base = f"base AS (SELECT {key}, {', '.join(cols)} FROM {table})"
    ctes = [*first, base] + [_fence_cte(f"f_{c}", "base", c) for c in cols]
    exprs = []
    for c in cols:
        fc = f"(SELECT {{}} FROM f_{c})"
        lo, hi, med, sk = (fc.format(v) for v in ("lo", "hi", "med", "sk"))
        out = f"({c} < {lo} OR {c} > {hi})"
        if method == "median":
            exprs.append(f"CASE WHEN {out} THEN {med} ELSE {c} END AS {c}")
        else:
            exprs.append(f"CASE WHEN abs({sk}) > 1 THEN (CASE WHEN {out} THEN {med} ELSE {c} END)"
                         f" ELSE least(greatest({c}, {lo}), {hi}) END AS {c}")
    return with_(ctes, f"SELECT {key}, {', '.join(exprs)} FROM base")


def outlier_remove_sql(cols=LI_COLS, first: tuple = (), table: str = "lineitem") -> str:
    key = "l_orderkey, l_linenumber"
    ctes = [*first, f"t0 AS (SELECT {key}, {', '.join(cols)} FROM {table})"]
    for i, c in enumerate(cols):
        src, dst = f"t{i}", f"t{i + 1}"
        ctes.append(_fence_cte(f"f{i}", src, c))
        lo, hi, med, sk = (f"(SELECT {v} FROM f{i})" for v in ("lo", "hi", "med", "sk"))
        out = f"({c} < {lo} OR {c} > {hi})"
        others = [x for x in cols if x != c]
        ctes.append(
            f"{dst} AS (SELECT {key}, " + ", ".join(others) +
            f", CASE WHEN abs({sk}) > 1 AND {out} THEN {med} ELSE {c} END AS {c} FROM {src}"
            f" WHERE abs({sk}) > 1 OR NOT {out} OR {c} IS NULL)")
    return with_(ctes, f"SELECT {key}, {', '.join(cols)} FROM t{len(cols)}")


def scaler_fit_sql(cols=LI_COLS) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean,"
        f" CASE WHEN stddev_pop({c}) = 0 OR stddev_pop({c}) IS NULL THEN 1.0 ELSE stddev_pop({c}) END AS scale"
        f" FROM lineitem" for c in cols)


def scaled_sql(cols=LI_COLS) -> str:
    ctes = [f"p_{c} AS (SELECT avg({c}) AS m, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s FROM lineitem)"
            for c in cols]
    exprs = ", ".join(f"round_even(({c} - (SELECT m FROM p_{c})) / (SELECT s FROM p_{c}) * 1000, 0) / 1000 AS {c}"
                      for c in cols)
    return with_(ctes, f"SELECT l_orderkey, l_linenumber, {exprs} FROM lineitem")


def corr_sql(src: str, features: list[str], target: str) -> str:
    """Pearson (population moments, NULL on zero std) and Spearman (average
    ranks via window functions over raw rows) for each feature."""
    parts = []
    for c in features:
        ranked = (f"(SELECT rank() OVER (ORDER BY CAST({c} AS DOUBLE)) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx,"
                  f" rank() OVER (ORDER BY CAST({target} AS DOUBLE)) + (count(*) OVER (PARTITION BY {target}) - 1) / 2.0 AS ry"
                  f" FROM {src} WHERE {c} IS NOT NULL AND {target} IS NOT NULL)")
        parts.append(
            f"SELECT '{c}' AS feature,"
            f" (SELECT CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 AND stddev_pop(CAST({target} AS DOUBLE)) > 0"
            f" THEN covar_pop(CAST({c} AS DOUBLE), CAST({target} AS DOUBLE)) / (stddev_pop(CAST({c} AS DOUBLE)) * stddev_pop(CAST({target} AS DOUBLE))) END FROM {src}) AS pearson,"
            f" (SELECT CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) > 0 AND stddev_pop(CAST({target} AS DOUBLE)) > 0"
            f" THEN (SELECT covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) FROM {ranked} rr) END FROM {src}) AS spearman")
    return "\nUNION ALL\n".join(parts)


def pearson_matrix_sql(cols=LI_COLS, table: str = "lineitem") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature_i, '{b}' AS feature_j,"
        f" CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END AS r FROM {table}"
        for a in cols for b in cols)


def _det(m: list[list[str]]) -> str:
    """A determinant of SQL terms, expanded along the first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {m[0][j]} * " + _det([r[:j] + r[j + 1:] for r in m[1:]])
                          for j in range(len(m))) + ")"


def vif_sql(intercept: bool, cols=LI_COLS, table: str = "lineitem") -> str:
    """VIF of every column as a cofactor over the determinant of the correlations (or, without
    intercept, of the cosines)."""
    term = (lambda a, b: f"corr({a}, {b})") if intercept else (
        lambda a, b: f"sum({a} * {b}) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b})))")
    p = len(cols)
    name = [[f"m{min(i, j)}_{max(i, j)}" if i != j else "1.0::DOUBLE" for j in range(p)] for i in range(p)]
    cells = ", ".join(f"{term(cols[i], cols[j])} AS m{i}_{j}" for i in range(p) for j in range(i + 1, p))
    rest = lambda i: [[name[a][b] for b in range(p) if b != i] for a in range(p) if a != i]
    return f"WITH m AS (SELECT {cells} FROM {table})\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {_det(rest(i))} / {_det(name)} AS vif, false AS collinear FROM m"
        for i, c in enumerate(cols))


def class_balance_sql(src: str, target: str) -> str:
    return (f"SELECT {target} AS class, n, n * 100.0 / sum(n) OVER () AS percent,"
            f" CAST(min(n) OVER () AS DOUBLE) / max(n) OVER () AS balance_ratio,"
            f" CAST(min(n) OVER () AS DOUBLE) / max(n) OVER () < 0.2 AS severe"
            f" FROM (SELECT {target}, count(*) AS n FROM {src} GROUP BY {target}) c")


# ------------------------------------------------------------------ selection
def top_by_sql(corr_body: str, column: str, n: int) -> str:
    return (f"WITH corr AS ({corr_body}),\n"
            f"pos AS (SELECT feature, {column}, 0 AS s FROM corr WHERE {column} > 0 ORDER BY {column} DESC, feature LIMIT {n}),\n"
            f"neg AS (SELECT feature, {column}, 1 AS s FROM corr WHERE {column} < 0 ORDER BY {column} ASC, feature LIMIT {n})\n"
            f"SELECT feature, {column}, CAST(row_number() OVER (ORDER BY s, {column} DESC, feature) AS INTEGER) AS position"
            f" FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) u")


def disagreement_sql(corr_body: str, gap: float = 0.1) -> str:
    return (f"WITH corr AS ({corr_body}) SELECT feature, pearson, spearman, abs(pearson - spearman) AS gap"
            f" FROM corr WHERE abs(pearson - spearman) > {gap}")


def chart_sql(corr_body: str, k: int = 10) -> str:
    return (f"WITH corr AS ({corr_body}),\n"
            "c AS (SELECT feature, COALESCE(pearson, 0.0) AS pearson, COALESCE(spearman, 0.0) AS spearman FROM corr),\n"
            "f AS (SELECT min(pearson) AS lo, max(pearson) AS hi FROM c)\n"
            f"SELECT * FROM (SELECT c.* FROM c, f WHERE f.lo >= 0 ORDER BY pearson DESC, feature LIMIT {k})\n"
            f"UNION ALL SELECT * FROM (SELECT c.* FROM c, f WHERE f.hi <= 0 AND f.lo < 0 ORDER BY pearson ASC, feature LIMIT {k})\n"
            f"UNION ALL SELECT * FROM (SELECT c.* FROM c, f WHERE f.lo < 0 AND f.hi > 0 AND pearson > 0 ORDER BY pearson DESC, feature LIMIT {k})\n"
            f"UNION ALL SELECT * FROM (SELECT c.* FROM c, f WHERE f.lo < 0 AND f.hi > 0 AND pearson < 0 ORDER BY pearson ASC, feature LIMIT {k})")


# ------------------------------------------------------------------ screening
def screen_sql(groups: dict, n_expr_prefix: str = "") -> str:
    """Columns screening_passed, screening_msg from wide recoded columns."""
    import math
    se = repr(math.sqrt(2.0 / 3.0))
    order = list(groups)
    vals = "list_concat(" + ", ".join("[" + ", ".join(groups[g]) + "]" for g in order) + ")" \
        if len(order) > 1 else "[" + ", ".join(groups[order[0]]) + "]"
    group_checks = []
    for g in order:
        arr = "[" + ", ".join(groups[g]) + "]"
        group_checks += [
            f"CASE WHEN NOT list_bool_and(list_transform({arr}, lambda x: x IS NOT NULL)) THEN 'Non-integer values in {g}' END",
            f"CASE WHEN NOT list_bool_and(list_transform({arr}, lambda x: floor(x) >= 1 AND floor(x) <= 3)) THEN 'Values in {g} must be between 1 and 3' END",
        ]
    z = f"((CAST(list_sum(ints) AS DOUBLE) / len(ints) - 2.0) / (CAST('{se}' AS DOUBLE) / sqrt(CAST(len(ints) AS DOUBLE))))"
    fail = ("COALESCE(" + ", ".join(group_checks + [
        "CASE WHEN len(ints) = 0 THEN 'No valid answers found' END",
        "CASE WHEN len(list_distinct(ints)) = 1 THEN 'All answers identical' END",
        f"CASE WHEN abs({z}) > 1.96 THEN printf('Anomalous score detected (z=%.2f)', {z}) END"]) + ")")
    ok = ("array_to_string(list_transform(list_sort(list_distinct(ints)), lambda k: CAST(k AS VARCHAR) || ' (' || "
          "CAST(CAST(trunc(CAST(len(list_filter(ints, lambda x: x = k)) AS DOUBLE) / len(ints) * 100) AS INTEGER) AS VARCHAR) || '%)'), ', ')")
    return (f"(SELECT {fail} IS NULL AS screening_passed, COALESCE({fail}, {ok}) AS screening_msg"
            f" FROM (SELECT list_transform({vals}, lambda x: CAST(floor(x) AS INTEGER)) AS ints) s)")


# ------------------------------------------------------------------ evaluation
SCORES_CTE = ("scores AS (SELECT l_orderkey * 8 + l_linenumber AS row_id,"
              " CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 10 AS score,"
              " CAST(l_discount * 10 >= 0.5 AS INTEGER) AS pred FROM lineitem)")


def counts_sql(z: float = 1.0) -> str:
    zl = f"CAST({z} AS DOUBLE)"
    return with_([SCORES_CTE], (
        "SELECT CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy,"
        f" COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), {zl}) AS precision,"
        f" COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), {zl}) AS recall,"
        f" COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), {zl}) AS f1,"
        " CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tn AS DOUBLE) AS tn, CAST(fn AS DOUBLE) AS fn"
        " FROM (SELECT sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,"
        " sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,"
        " sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn,"
        " sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn FROM scores) c"))


def confusion_sql() -> str:
    return with_([SCORES_CTE], "SELECT label, pred, count(*) AS n FROM scores GROUP BY label, pred")


def roc_auc_sql() -> str:
    return with_([SCORES_CTE], (
        "SELECT CASE WHEN P > 0 AND N > 0 THEN (rs - P * (P + 1) / 2.0) / (P * N) END AS roc_auc FROM ("
        " SELECT sum(CASE WHEN label = 1 THEN r END) AS rs, CAST(sum(label) AS DOUBLE) AS P,"
        " CAST(sum(1 - label) AS DOUBLE) AS N FROM ("
        "  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r"
        "  FROM scores) t) u"))


def pr_auc_sql() -> str:
    return with_([SCORES_CTE,
                  "cells AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM scores GROUP BY score)",
                  "cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,"
                  " sum(pos) OVER () AS P FROM cells)"],
                 "SELECT CASE WHEN max(P) > 0 THEN sum(pos / P * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0"
                 " THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1.0 END) / 2) END AS pr_auc FROM cum")


def accuracy_ci_sql(z: float) -> str:
    return with_([SCORES_CTE], (
        "SELECT acc AS accuracy, n,"
        f" greatest(0.0, acc - CAST('{z!r}' AS DOUBLE) * sqrt(acc * (1 - acc) / n)) AS accuracy_ci_lower,"
        f" least(1.0, acc + CAST('{z!r}' AS DOUBLE) * sqrt(acc * (1 - acc) / n)) AS accuracy_ci_upper"
        " FROM (SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM scores) a"))


def class_report_sql() -> str:
    parts = []
    for k in (0, 1):
        parts.append(
            f"SELECT {k} AS class, COALESCE(tp / NULLIF(tp + fp, 0), 0.0) AS precision,"
            f" COALESCE(tp / NULLIF(tp + fn, 0), 0.0) AS recall,"
            f" COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1, CAST(tp + fn AS BIGINT) AS support"
            f" FROM (SELECT CAST(sum(CASE WHEN label = {k} AND pred = {k} THEN 1 ELSE 0 END) AS DOUBLE) AS tp,"
            f" CAST(sum(CASE WHEN label <> {k} AND pred = {k} THEN 1 ELSE 0 END) AS DOUBLE) AS fp,"
            f" CAST(sum(CASE WHEN label = {k} AND pred <> {k} THEN 1 ELSE 0 END) AS DOUBLE) AS fn FROM scores) c")
    return with_([SCORES_CTE], "\nUNION ALL\n".join(parts))


# ------------------------------------------------------------------ resampling
def class_cte(src_sql: str) -> str:
    return f"cls AS (SELECT label, count(*) AS n FROM ({src_sql}) s GROUP BY label)"


def split_counts_sql(src_sql: str, test_size: float = 0.2) -> str:
    return with_([class_cte(src_sql),
                  f"tot AS (SELECT sum(n) AS n, CAST(ceil({test_size} * sum(n)) AS BIGINT) AS t FROM cls)",
                  "raw AS (SELECT label, cls.n, CAST(tot.t AS DOUBLE) * cls.n / tot.n AS x FROM cls, tot)",
                  "base AS (SELECT label, n, x, CAST(floor(x) AS BIGINT) AS b, x - floor(x) AS fr FROM raw)",
                  "lft AS (SELECT (SELECT t FROM tot) - sum(b) AS l FROM base)",
                  "alloc AS (SELECT label, n, b + CASE WHEN row_number() OVER (ORDER BY fr DESC, label) <= (SELECT l FROM lft) THEN 1 ELSE 0 END AS t FROM base)"],
                 "SELECT label, true AS is_test, t AS n FROM alloc WHERE t > 0 UNION ALL SELECT label, false AS is_test, n - t AS n FROM alloc WHERE n - t > 0")


def fold_counts_sql(src_sql: str, k: int = 5) -> str:
    return with_([class_cte(src_sql), f"folds AS (SELECT range AS fold FROM range({k}))"],
                 f"SELECT label, CAST(fold AS INTEGER) AS fold, n // {k} + CASE WHEN fold < n % {k} THEN 1 ELSE 0 END AS n"
                 f" FROM cls, folds WHERE n // {k} + CASE WHEN fold < n % {k} THEN 1 ELSE 0 END > 0")


def oversample_counts_sql(src_sql: str) -> str:
    return with_([class_cte(src_sql)],
                 "SELECT label, false AS synthetic, n FROM cls UNION ALL"
                 " SELECT label, true AS synthetic, (SELECT max(n) FROM cls) - n AS n FROM cls WHERE n < (SELECT max(n) FROM cls)")


def undersample_counts_sql(src_sql: str) -> str:
    return with_([class_cte(src_sql)], "SELECT label, (SELECT min(n) FROM cls) AS n FROM cls")


# ------------------------------------------------------------- prepare ops
IMPUTE_CTE = ("imp_src AS (SELECT o_orderkey,"
              " CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status,"
              " CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN NULL"
              " ELSE CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) END AS price_text FROM orders)")


def impute_sql() -> str:
    return with_([IMPUTE_CTE,
                  "coerced AS (SELECT o_orderkey, status, TRY_CAST(CASE WHEN regexp_full_match(price_text, '\\s*[+-]?[0-9]+(\\.[0-9]*)?\\s*') THEN price_text END AS DOUBLE) AS price FROM imp_src)",
                  "mode AS (SELECT status FROM coerced WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)",
                  "med AS (SELECT quantile_cont(price, 0.5) AS m FROM coerced)"],
                 "SELECT o_orderkey, COALESCE(status, (SELECT status FROM mode)) AS status,"
                 " COALESCE(price, (SELECT m FROM med)) AS price FROM coerced")


def label_encode_sql() -> str:
    return ("SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY COALESCE(p_brand, 'missing')) - 1 AS BIGINT) AS p_brand"
            " FROM part")


def legacy_cohort_sql() -> str:
    k = "CAST(c_custkey AS BIGINT)"
    sets = ", ".join(f"CAST(1 + (({k} * {p} + {1009 * i}) % 10007) % 3 AS INTEGER) AS set{i}"
                     for i, p in enumerate(ANSWER_PRIMES[:11], 1))
    return with_([f"u AS (SELECT {k} AS user_id, {sets}, CAST({k} % 7 AS INTEGER) AS init_payoff_score,"
                  f" CAST(({k} * 31) % 11 AS INTEGER) AS payoff_score FROM customer)",
                  "s AS (SELECT *, CAST(CASE WHEN user_id % 13 = 0 THEN 2 WHEN set1 + set2 + (user_id * 17) % 5 >= 7 THEN 1"
                  " ELSE 0 END AS INTEGER) AS user_status FROM u)"],
                 "SELECT * FROM s WHERE user_status = 1 OR (user_status = 0 AND payoff_score > 4)")


def pending_customers_sql() -> str:
    return ("SELECT CAST(c_custkey AS BIGINT) AS customer_id, CAST(0 AS INTEGER) AS processed FROM customer"
            " WHERE c_custkey % 3 = 0")


def quality_sql(src_ctes: list[str], src: str, cols: list[str], target: str, name: str) -> str:
    nn = ", ".join(f"count({c}) AS nn_{i}" for i, c in enumerate(cols))
    greatest_nn = "greatest(" + ", ".join(f"nn_{i}" for i in range(len(cols))) + ")"
    return with_(src_ctes + [f"a AS (SELECT count(*) AS n, {nn}, count(DISTINCT {target}) AS nt FROM {src})"],
                 f"SELECT '{name}' AS frame, 'non_empty' AS \"check\", n > 0 AS passed, 'rows=' || CAST(n AS VARCHAR) AS detail FROM a"
                 f" UNION ALL SELECT '{name}', 'min_rows', n >= 1, 'min=1 rows=' || CAST(n AS VARCHAR) FROM a"
                 f" UNION ALL SELECT '{name}', 'min_cols', true, 'min=1 cols={len(cols)}' FROM a"
                 f" UNION ALL SELECT '{name}', 'not_all_null', {greatest_nn} > 0, '' FROM a"
                 f" UNION ALL SELECT '{name}', 'target_present', true, '{target}' FROM a"
                 f" UNION ALL SELECT '{name}', 'target_two_classes', nt >= 2, CAST(nt AS VARCHAR) FROM a"
                 f" UNION ALL SELECT '{name}', 'numeric_only', true, '' FROM a"
                 f" UNION ALL SELECT '{name}', 'required_features', true, '' FROM a")


def payload_cte(with_set: bool = False) -> str:
    items = [f"{{'group': 'kmsi', 'item': '{i}', 'version': '1', 'choiceNumber': kmsi{i}}}" for i in range(8, 0, -1)]
    items += [f"{{'group': 'fht', 'item': '{i}', 'version': '1', 'choiceNumber': fht{i}}}" for i in range(8, 0, -1)]
    arr = "[" + ", ".join(items) + "]"
    return ("payloads AS (SELECT user_id AS resp_id,"
            " CASE WHEN user_id % 97 = 0 THEN 'unknown_label' ELSE 'rdf50_v3.0_fk_v1.0' END AS application_label,"
            f" CASE WHEN user_id % 89 = 0 THEN list_filter({arr}, lambda x: NOT (x.\"group\" = 'kmsi' AND x.item = '3'))"
            f" ELSE {arr} END AS answers FROM answers_wide)")


def select_answers_sql(groups=("fht", "kmsi")) -> str:
    cols = []
    for g in groups:
        picked = (f"list_filter(list_transform(answers, lambda x, i: {{'k': TRY_CAST(trim(x.item) AS INTEGER), 'pos': i, 'c': x.choiceNumber,"
                  f" 'g': x.\"group\", 'v': x.version}}), lambda y: y.g = '{g}' AND y.v = '1')")
        cols.append(f"array_to_string(list_transform(list_sort(list_transform({picked}, lambda y: {{'k': y.k, 'pos': y.pos, 'c': y.c}})), lambda z: z.c), ',') AS {g}")
    return with_([cte_answers_wide(), payload_cte()], f"SELECT resp_id, {', '.join(cols)} FROM payloads")


def route_sql() -> str:
    return with_([cte_answers_wide(), payload_cte()],
                 "SELECT resp_id, application_label, CASE WHEN application_label = 'rdf50_v3.0_fk_v1.0' THEN 'fk_v1.0' END AS spec,"
                 " CASE WHEN application_label = 'rdf50_v3.0_fk_v1.0' THEN NULL ELSE 'Unsupported application_label: ' || application_label END AS route_reason"
                 " FROM payloads")


def group_answers_sql() -> str:
    return with_([cte_answers_wide(), payload_cte(),
                  "items AS (SELECT resp_id, unnest(answers) AS x, generate_subscripts(answers, 1) AS pos FROM payloads)"],
                 "SELECT resp_id, x.\"group\" AS \"group\", array_to_string(list(COALESCE(x.choiceNumber, 0) ORDER BY"
                 " CASE WHEN regexp_full_match(x.item, '[0-9]+') THEN TRY_CAST(x.item AS BIGINT) ELSE 0 END, pos), ',')"
                 " AS choices FROM items WHERE x.\"group\" IS NOT NULL AND x.\"group\" <> '' GROUP BY resp_id, x.\"group\"")
