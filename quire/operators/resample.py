"""Splits and resampling (R1-R8), deterministic by seed.

Per-class ranks come from a hash of (seed, key): exact ranks by a
two-level prefix sum (counts per 16-bit hash bucket, then a window inside
each bucket), so a class holding a third of all rows is spread over
65,536 buckets instead of one task.  Synthetic rows (SMOTE family) are
random by nature: tests check counts, balance and convex-segment
membership, never exact values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.neighbours import Metric, search
from quire.session import cut_lineage

HASH_BUCKETS = 65536


def _h(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def hash_rank(df: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """Adds ``rank`` (1..n_c) within each ``by`` class, ordered by
    (xxhash64(seed, key), key): a deterministic shuffle."""
    h = df.withColumn("_h", _h(seed, F.col(key)))
    h = h.withColumn("_bk", F.shiftrightunsigned("_h", 48))
    cnt = h.groupBy(by, "_bk").agg(F.count(F.lit(1)).alias("_bkn"))
    wb = Window.partitionBy(by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select(by, "_bk", F.coalesce(F.sum("_bkn").over(wb), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(by, "_bk").orderBy("_h", key)
    j = h.join(off, [by, "_bk"])
    return j.withColumn("rank", F.col("_off") + F.row_number().over(wi)).drop("_h", "_bk", "_off")


def class_counts(df: DataFrame, by: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(by).count().collect()}


def _per_class(column: str, values: dict) -> Column:
    return F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast("bigint"))]),
                        F.col(column))


def _reached(cells: DataFrame, order: list[str], need: dict) -> dict:
    """Per class the cell (``_c``, order.., ``n``) in which the running count reaches ``need``, as a row with ``upto``."""
    upto = F.sum("n").over(Window.partitionBy("_c").orderBy(*order))
    rows = (cells.withColumn("upto", upto).withColumn("_need", _per_class("_c", need))
            .where((F.col("upto") >= F.col("_need")) & (F.col("upto") - F.col("n") < F.col("_need"))).collect())
    return {r["_c"]: r for r in rows}


def first_of_class(df: DataFrame, by: str, key: str, take: dict, counts: dict, seed: int = 42) -> Column | None:
    """A condition on ``df``, true for the ``take[c]`` rows of each class c that come first by
    (xxhash64(seed, key), key): those of least ``hash_rank``.

    The last hash taken is selected by refining a histogram: counts over the 16 leading
    bits, then over the next 16 inside the one bucket it lies in, then over the few keys that
    share 32 bits.  Only counts are shuffled, at most one row a class reaches the driver, and the
    condition itself moves no row.  None if rows of one key lie on both sides of the end.
    """
    need = {c: k for c, k in take.items() if 0 < k < counts[c]}
    last, lead = {}, {}
    if need:
        h = (df.select(F.col(by).alias("_c"), F.col(key).alias("_key")).where(F.col("_c").isin(*need))
             .withColumn("_h", _h(seed, F.col("_key"))))
        left = dict(need)
        for bits in (16, 32):
            inside = h.where(F.shiftrightunsigned("_h", 80 - bits) == _per_class("_c", lead)) if lead else h
            cells = inside.groupBy("_c", F.shiftrightunsigned("_h", 64 - bits).alias("_at")).agg(F.count(F.lit(1)).alias("n"))
            hit = _reached(cells, ["_at"], left)
            lead = {c: r["_at"] for c, r in hit.items()}
            left = {c: left[c] - (r["upto"] - r["n"]) for c, r in hit.items()}
        cells = (h.where(F.shiftrightunsigned("_h", 32) == _per_class("_c", lead))
                 .groupBy("_c", "_h", "_key").agg(F.count(F.lit(1)).alias("n")))
        last = _reached(cells, ["_h", "_key"], left)
        if any(r["upto"] != left[c] for c, r in last.items()):
            return None
    here, kind = _h(seed, F.col(key)), df.schema[key].dataType
    at, out = F.shiftrightunsigned(here, 32), None
    for c, k in take.items():
        inside = F.lit(k > 0)
        if c in last:
            r = last[c]
            # nulls sort first and are alone with their hash
            upto = F.col(key).isNull() if r["_key"] is None else F.coalesce(F.col(key) <= F.lit(r["_key"]).cast(kind), F.lit(True))
            inside = (at < lead[c]) | ((at == lead[c]) & ((here < r["_h"]) | ((here == r["_h"]) & upto)))
        out = F.when(F.col(by) == c, inside) if out is None else out.when(F.col(by) == c, inside)
    return F.lit(False) if out is None else out.otherwise(False)


def stratified_shares(counts: dict, total_take: int) -> dict:
    """Largest-remainder split of ``total_take`` over classes in proportion
    to their counts (remainder ties -> smaller class value)."""
    n = sum(counts.values())
    raw = {c: total_take * v / n for c, v in counts.items()}
    base = {c: int(np.floor(x)) for c, x in raw.items()}
    left = total_take - sum(base.values())
    for c in sorted(raw, key=lambda c: (-(raw[c] - base[c]), c))[:left]:
        base[c] += 1
    return base


def stratified_split(df: DataFrame, by: str, key: str, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_test``; exactly ceil(test_size * n) test rows, shared
    over classes by largest remainder.  A plain condition on the key (``first_of_class``);
    rows are ranked only where a key's copies must be parted."""
    counts = class_counts(df, by)
    n_test = int(np.ceil(test_size * sum(counts.values())))
    take = stratified_shares(counts, n_test)
    first = first_of_class(df, by, key, take, counts, seed)
    if first is not None:
        return df.withColumn("is_test", first)
    tk =F.create_map(*[x for c, v in take.items() for x in (F.lit(c), F.lit(v))])
    r = hash_rank(df, by, key, seed)
    return r.withColumn("is_test", F.col("rank") <= F.element_at(tk, F.col(by))).drop("rank")


def random_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """R1 unstratified (legacy script): exactly ceil(test_size * n) rows."""
    return stratified_split(df.withColumn("_all", F.lit(0)), "_all", key, test_size, seed).drop("_all")


def stratified_folds(df: DataFrame, by: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """R2: ``fold`` = (shuffled rank within class - 1) mod k."""
    return hash_rank(df, by, key, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def undersample(df: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """Keep min(n_c) shuffled rows of every class, by a condition on the key as R1."""
    counts = class_counts(df, by)
    if not counts:
        return df
    m = min(counts.values())
    first = first_of_class(df, by, key, dict.fromkeys(counts, m), counts, seed)
    if first is not None:
        return df.where(first)
    return hash_rank(df, by, key, seed).where(F.col("rank") <= m).drop("rank")


def _draws(spark, needs: dict, seed: int, salt: int) -> DataFrame:
    """One row per synthetic draw: (class, j) for j < need_c, generated by
    Spark ranges (distributed, proportional to the draws)."""
    frames = [spark.range(v).select(F.lit(c).alias("_cls"), F.col("id").alias("_j"))
              for c, v in needs.items() if v > 0]
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn("_u", _h(seed + salt, F.col("_cls"), F.col("_j")))


def oversample_random(df: DataFrame, by: str, key: str, seed: int = 42) -> DataFrame:
    """Every class up to the majority count by drawing rows with
    replacement (exact counts).  Draw j of class c takes the row of shuffled
    rank pmod(hash(seed, c, j), n_c) + 1; an equi-join on (class, rank)."""
    counts = class_counts(df, by)
    mx = max(counts.values())
    draws = _draws(df.sparkSession, {c: mx - v for c, v in counts.items()}, seed, 1)
    if draws is None:
        return df.withColumn("synthetic", F.lit(False))
    nmap = F.create_map(*[x for c, v in counts.items() for x in (F.lit(c), F.lit(v))])
    d = draws.select(F.col("_cls").alias(by),
                     (F.pmod(F.col("_u"), F.element_at(nmap, F.col("_cls"))) + 1).alias("rank"))
    ranked = hash_rank(df, by, key, seed)
    extra = d.join(ranked, [by, "rank"]).drop("rank").select(*df.columns)
    return df.withColumn("synthetic", F.lit(False)).unionByName(extra.withColumn("synthetic", F.lit(True)))


# ------------------------------------------------------------------ SMOTE family
def _vec(c: str) -> Column:
    return F.col(c).cast("array<double>")


def _interpolate(x: Column, nn: Column, u: Column) -> Column:
    return F.zip_with(x, nn, lambda a, b: a + u * (b - a))


def category_penalties(rows: DataFrame, classes: list, categorical_idx: tuple) -> dict:
    """For each class the squared distance that a differing category counts.

    The median, over the other positions, of the class's standard deviations stands at one-hot
    entries in halves, so a differing pair adds ``median ** 2 / 2``.
    """
    spread = (rows.where(F.col("label").isin(classes)).select("label", F.posexplode("v").alias("pos", "x"))
              .where(~F.col("pos").isin(list(categorical_idx)))
              .groupBy("label", "pos").agg(F.stddev_pop("x").alias("s"))
              .groupBy("label").agg(F.median("s").alias("m")).collect())
    known = {r["label"]: r["m"] ** 2 / 2 for r in spread}
    return {c: known.get(c, 0.0) for c in classes}


#: Synthetic rows of one seed that a task makes at a time.
DRAWS = 10_000


def smote_family(df: DataFrame, label: str, key: str, vec: str, method: str = "smote",
                 k: int = 3, m: int = 10, seed: int = 42, categorical_idx: tuple = (),
                 block_rows: int | None = None) -> DataFrame:
    """R5 SMOTE, R6 ADASYN, R7 SMOTENC, R8 BorderlineSMOTE (borderline-1).

    Minority classes are raised to the majority count.  Seeds:
    SMOTE/SMOTENC - every minority row; Borderline - minority rows in danger
    (m/2 <= majority among m nearest of all rows < m); ADASYN - rows in
    proportion to their majority share among k nearest of all rows.  A
    synthetic row is x + u * (nn - x) toward one of the seed's k nearest
    minority neighbours; SMOTENC gives categorical positions the most
    frequent neighbour value instead and counts them in the distance
    (``category_penalties``).  Output adds ``synthetic``.

    One neighbour search serves all classes.  A seed, its neighbours' vectors and its
    number of draws are one row, so a seed with very many draws joins nothing; its draws are made in
    pieces of ``DRAWS`` that are dealt out over tasks.
    """
    if method not in ("smote", "adasyn", "smotenc", "borderline"):
        raise ValueError(f"unknown resampling method {method!r}")
    counts = class_counts(df, label)
    mx = max(counts.values())
    base = df.select(key, label, _vec(vec).alias(vec))
    pieces = [base.withColumn("synthetic", F.lit(False))]
    needs = {c: mx - n for c, n in sorted(counts.items()) if n < mx and n >= 2}
    if not needs:
        return pieces[0]
    rows = base.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vec).alias("v"),
                       F.col(label).isin(list(needs)).alias("query"))
    of_all = {"borderline": m, "adasyn": k}.get(method, 0)
    metric = Metric()
    if of_all:
        rows = rows.withColumn("part", F.lit(0))
    else:  # only rows of a class are compared
        rows = rows.where("query").withColumn("part", F.col("label"))
        if method == "smotenc" and categorical_idx:
            metric = Metric(tuple(categorical_idx), category_penalties(rows, list(needs), categorical_idx))
    near = cut_lineage(search(rows, k, of_all, metric, block_rows).frame)
    vectors = rows.where("query").select(F.col("id").alias("nid"), F.col("v").alias("nv"))
    sides = (near.where("rank_same is not null").join(vectors, "nid").groupBy("qid")
             .agg(F.sort_array(F.collect_list(F.struct("rank_same", "nv"))).alias("near")))
    queries = rows.where("query").select(F.col("id").alias("qid"), F.col("label").alias("_c"), F.col("v").alias("_x")).join(sides, "qid")
    for cls, need in needs.items():
        kk = min(k, counts[cls] - 1)
        minority = queries.where(F.col("_c") == cls)
        if of_all:
            mm = m if method == "borderline" else kk
            maj = near.where(F.col("rank_all") <= mm).groupBy("qid").agg(F.sum((~F.col("same")).cast("int")).alias("n_maj"))
            w = (F.when((F.col("n_maj") >= mm / 2.0) & (F.col("n_maj") < mm), 1.0) if method == "borderline"
                 else F.col("n_maj") / float(mm))
            seeds = minority.join(maj, "qid").withColumn("w", w).where("w > 0")
        else:
            seeds = minority.withColumn("w", F.lit(1.0))
        # Every seed gets floor(need * w / W) rows plus one for the first seeds in
        # shuffled order: exact total, proportional to the weights (uniform for
        # SMOTE/Borderline; the majority share for ADASYN).
        ranked = cut_lineage(hash_rank(seeds, "_c", "qid", seed))
        total = ranked.agg(F.sum("w").alias("W")).first()["W"]
        if not total:
            continue
        ranked = ranked.withColumn("_base", F.floor(F.col("w") * need / F.lit(total)).cast("long"))
        left = need - ranked.agg(F.sum("_base")).first()[0]
        alloc = ranked.withColumn("_n", F.col("_base") + (F.col("rank") <= left).cast("long")).where("_n > 0")
        chunks = alloc.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / DRAWS))))
        if need > DRAWS:
            chunks = chunks.repartition(F.col("qid"), F.col("_at"))
        draws = chunks.withColumn("_j", F.explode(F.sequence(
            F.col("_at") * DRAWS + 1, F.least(F.col("_n"), (F.col("_at") + 1) * DRAWS))))
        pick = F.pmod(_h(seed + 7, F.col("qid"), F.col("_j")), F.lit(kk)).cast("int")
        u = F.pmod(_h(seed + 11, F.col("qid"), F.col("_j")), F.lit(2 ** 30)).cast("double") / float(2 ** 30)
        new = _interpolate(F.col("_x"), F.get(F.col("near"), pick)["nv"], u)
        for i in categorical_idx if method == "smotenc" else ():
            vals = F.transform("near", lambda s: s["nv"][i])  # noqa: B023
            seen = F.transform(F.array_distinct(vals), lambda v: F.struct(
                (-F.size(F.filter(vals, lambda y: y == v))).alias("neg_n"), v.alias("v")))  # noqa: B023
            mode = F.array_min(seen)["v"]
            new = F.transform(new, lambda a, pos: F.when(pos == i, mode).otherwise(a))  # noqa: B023
        # synthetic ids are negative, derived from (seed, source row, draw)
        pieces.append(draws.select((-F.pmod(_h(seed + 13, F.col("qid"), F.col("_j")), F.lit(2 ** 62)) - 1).alias(key),
                                   F.lit(cls).alias(label), new.alias(vec), F.lit(True).alias("synthetic")))
    res = pieces[0]
    for p in pieces[1:]:
        res = res.unionByName(p)
    return res
