"""Embedding near-duplicates by a pivot-permutation index (operator 6).

Reference vectors (pivots) are chosen per label by hash; a vector is described
by its nearest pivots in order.  Vectors are posted under their first
``prefix`` pivots, and two vectors of a list become a candidate pair when
their prefixes share at least ``shared`` pivots.  Candidates are verified by
cosine in double precision.  A label has about as many pivots as the square
root of its vectors, so lists grow slower than the label.

Equal vectors are one class from the start.  A list is cut into blocks; every
pair of blocks is one group, compared as matrices, which emits one row for
each vector (its number of partners and one of them for its block component)
and never a row for each pair.  A pair that shares several lists counts only
in the least of them.

Defined cases: rows whose label or vector is null, whose vector is zero or has
null or non-finite components, or whose length no other has, link with
nothing.  Repeated rows are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import components, stage


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the rows that can link."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                          F.col("embedding").cast("array<double>").alias("v"))
    return rows.where("label is not null and v is not null").where(
        ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id to rep; one row per distinct vector of a label with its copies)."""
    keyed = rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256))
    groups = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = stage(keyed.select("vec_id", "key").join(groups, "key").select("vec_id", "rep", "copies"), "members")
    # dropDuplicates, not the least id alone: that id may repeat with another vector.
    distinct = keyed.join(groups.select("key", "copies", F.col("rep").alias("vec_id")), ["key", "vec_id"]).dropDuplicates(["key"])
    return members, distinct.select(F.col("vec_id").alias("rep"), "copies", "label", F.size("v").alias("dim"), "v")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(distinct: DataFrame, sizes: DataFrame) -> DataFrame:
    """``label, dim, number, p``: of each label the ``want`` vectors of least hash.

    About twice as many are drawn by hash first, so ranking sees few rows of a label.
    """
    hashed = F.pmod(F.xxhash64("rep", F.lit("pivot")), F.lit(1 << 30))
    drawn = (distinct.join(sizes, ["label", "dim"]).withColumn("hash", hashed)
             .where(F.col("hash") < F.col("want") * 2 / F.col("n") * (1 << 30)))
    rank = Window.partitionBy("label", "dim").orderBy("hash", "rep")
    return (drawn.withColumn("number", F.row_number().over(rank) - 1).where("number < want")
            .select("label", "dim", "number", F.col("v").alias("p"), "chunks"))


def describe(distinct: DataFrame, *, prefix: int, least: int, most: int, chunk_rows: int) -> DataFrame:
    """``distinct`` with ``near``: the numbers of each vector's first ``prefix`` pivots, nearest first.

    A label's vectors are dealt in chunks, and its pivots (``most`` at most) go to each chunk.
    """
    sizes = stage(distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select(
        "label", "dim", "n", F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.sqrt("n")))).alias("want"),
        F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")), "label-sizes")
    pivots = choose_pivots(distinct, sizes).withColumn(
        "of_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.col("label").alias("of_label"), F.col("dim").alias("of_dim"), "of_chunk", "number", "p")
    dealt = (distinct.join(sizes.select("label", "dim", "chunks"), ["label", "dim"])
             .withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")).cast("int")).drop("chunks"))

    def order(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in (*names, "near")})
        near = [[0]] * len(rows)
        if len(found):
            found = found.sort_values("number")
            cosine = unit(np.stack(rows["v"].to_numpy())) @ unit(np.stack(found["p"].to_numpy())).T
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :prefix].tolist()
        return rows[names].assign(near=near)

    names = distinct.columns
    out = distinct.withColumn("near", F.array(F.lit(0).cast("long"))).schema
    return dealt.groupBy("label", "dim", "chunk").cogroup(
        pivots.groupBy("of_label", "of_dim", "of_chunk")).applyInPandas(order, out)


def compare(left: pd.DataFrame, right: pd.DataFrame, pivot: int, threshold: float, shared: int) -> pd.DataFrame:
    """Links between two blocks of one list: per vector its partners' copies and the least partner's component."""
    same = right is left
    both = left if same else pd.concat([left, right], ignore_index=True)
    n, rep = len(left), both["rep"].to_numpy()
    x = unit(np.stack(both["v"].to_numpy()))
    member = np.zeros((len(both), max(max(p) for p in both["near"]) + 1), dtype="float32")
    for i, p in enumerate(both["near"]):
        member[i, p] = 1
    a, b = (slice(0, n), slice(0, n)) if same else (slice(0, n), slice(n, None))
    need = np.minimum(shared, np.minimum(member[a].sum(1)[:, None], member[b].sum(1)[None, :]))
    # Shared pivots in all, and none before this list's.
    linked = (member[a] @ member[b].T >= need) & (member[a][:, :pivot] @ member[b][:, :pivot].T == 0)
    linked &= x[a] @ x[b].T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    copies = both["copies"].to_numpy()
    count = np.zeros(len(both), dtype="int64")
    count[a] += linked @ copies[b]
    if not same:
        count[b] += linked.T @ copies[a]
    # Block components: least rep, passed along links until nothing changes.
    label = rep.copy()
    while True:
        to_a = np.where(linked, label[b][None, :], np.iinfo("int64").max).min(axis=1, initial=np.iinfo("int64").max)
        new = label.copy()
        new[a] = np.minimum(new[a], to_a)
        if not same:
            to_b = np.where(linked, new[a][:, None], np.iinfo("int64").max).min(axis=0, initial=np.iinfo("int64").max)
            new[b] = np.minimum(new[b], to_b)
        if (new == label).all():
            break
        label = new
    hit = count > 0
    return pd.DataFrame({"rep": rep[hit], "partners": count[hit], "least": label[hit]})


def near_vectors(vectors: DataFrame, *, threshold: float = 0.98, prefix: int = 8, shared: int = 2,
                 least_pivots: int = 16, most_pivots: int = 1024, block_rows: int = 1024) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    members, distinct = classes_of(usable(vectors))
    distinct = stage(distinct, "vectors")
    indexed = stage(describe(distinct, prefix=prefix, least=least_pivots, most=most_pivots, chunk_rows=4 * block_rows),
                    "described")
    posted = indexed.withColumn("pivot", F.explode("near"))
    lists = posted.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    blocked = (posted.join(lists, ["label", "dim", "pivot"]).withColumn("parts", parts)
               .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")))
    # Every block meets every block from itself on: group (i, j) holds blocks i and j.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    paired = (blocked.select("*", other)
              .select("label", "dim", "pivot", "rep", "copies", "v", "near", "block",
                      F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, pivot = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0]), int(pdf["pivot"].iloc[0])
        pdf = pdf.sort_values("rep", kind="stable")
        left = pdf[pdf["block"] == i].reset_index(drop=True)
        right = left if i == j else pdf[pdf["block"] == j].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "partners": [], "least": []}).astype("int64")
        return compare(left, right, pivot, threshold, shared)

    links = stage(paired.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(
        search, "rep long, partners long, least long"), "vector-links")
    partners = links.groupBy("rep").agg(F.sum("partners").alias("partners"))
    found = components(links.select(F.col("rep").alias("src"), F.col("least").alias("dst")))
    known = (members.join(partners, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
             .select("vec_id", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).exceptAll(members.select("vec_id")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
