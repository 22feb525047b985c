"""Exact nearest neighbours through a metric partition index (used by R5-R8).

Rows of equal vectors are one cell, which lists for each label its rows of least id: as many as a
query can need.  Cells are laid into blocks around centres (cells chosen by hash), as many as the
rows and the vector width ask for; what a centre draws beyond a block is dealt out over
several.  All query rows of a cell and label are one unit.  A unit first searches its own block, which bounds the
distance of its last neighbour.  By the triangle inequality another block can hold a nearer row only if

    max(distance to its centre - its radius, its least distance - distance to its centre) <= bound,

so blocks that no unit of a block can need are never paired with it, and in a
visited pair only the units that need it are compared, with those leaves of the block (boxes of about ``LEAF``
cells, split at medians) that lie within their bounds.  Nothing else is left out: the result is that of comparing all rows.

The metric is Euclidean; positions in ``categories`` count ``penalty`` (of squared
distance) where they differ, which is Euclidean too (one-hot entries), so the bounds hold.

The driver holds the centres (at most ``MAX_CENTRES``) and four numbers for each
block of ``BLOCK_BYTES`` or more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: A block's vectors; with more rows than ``BLOCKS`` such blocks hold, blocks grow up to ``WIDEN`` times.
BLOCK_BYTES, BLOCKS, WIDEN = 8 << 20, 32, 8
MAX_CENTRES = 4096
CELLS = 4_000_000  # distances a task holds at once
LEAF, GROUP = 256, 128  # cells of a leaf and units that are compared with leaves at a time
STEP = 4096  # cells that a group is compared with at a time
SLACK = 1e-9  # rounding of distances, relative and absolute


@dataclass
class Neighbours:
    """``frame(qid, nid, dist, same, rank_same, rank_all)`` and the work: blocks, pairs of blocks, pairs visited."""

    frame: DataFrame
    blocks: int
    pairs: int
    visited: int


@dataclass
class Metric:
    """Squared distances; ``penalty`` by part for positions in ``categories``."""

    categories: tuple[int, ...] = ()
    penalty: dict | None = None

    def squared(self, a: np.ndarray, b: np.ndarray, part) -> np.ndarray:
        cats = list(self.categories)
        x, y = (np.delete(v, cats, axis=1) for v in (a, b)) if cats else (a, b)
        middle = y.mean(axis=0) if len(y) else 0.0  # nearer to the origin, less is lost to rounding
        x, y = x - middle, y - middle
        d2 = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0.0)
        for c in cats:
            d2 += self.penalty[part] * (a[:, c][:, None] != b[:, c][None, :])
        return d2

    def distance(self, a: np.ndarray, b: np.ndarray, part) -> np.ndarray:
        """Of rows to rows, one to one, without cancellation."""
        cats = list(self.categories)
        x, y = (np.delete(v, cats, axis=1) for v in (a, b)) if cats else (a, b)
        d2 = ((x - y) ** 2).sum(axis=1)
        for c in cats:
            d2 += self.penalty[part] * (a[:, c] != b[:, c])
        return np.sqrt(d2)


def _array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column) -> np.ndarray:
    """The vectors of a list column as rows."""
    a = _array(column)
    if not len(a):
        return np.zeros((0, 0))
    flat, n = a.flatten(), np.diff(a.offsets.to_numpy())
    if a.null_count or flat.null_count or (n != n[0]).any():
        raise ValueError("vectors must be of one length and without nulls")
    return flat.to_numpy(zero_copy_only=False).astype("float64").reshape(len(a), -1)


@dataclass
class Cells:
    """A block's cells: vectors, and the rows (id, label's code) of cell i at ``ends[i]:ends[i + 1]``."""

    v: np.ndarray
    ends: np.ndarray
    id: np.ndarray
    code: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Cells:
        rows = _array(table.column("rows"))
        flat, ends = rows.flatten(), rows.offsets.to_numpy()
        own = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)]
        return Cells(_matrix(table.column("v")), ends - ends[0], *own)

    def weights(self, code) -> np.ndarray:
        """Rows of each cell; with ``code``, of that label."""
        n = np.r_[0, np.cumsum(self.code == code)] if code is not None else np.arange(len(self.code) + 1)
        return n[self.ends[1:]] - n[self.ends[:-1]]


def leaves_of(v: np.ndarray, size: int) -> list[np.ndarray]:
    """The numbers of the vectors in leaves of at most ``size``, split at the median of their widest position."""
    out, open_ = [], [np.arange(len(v))]
    while open_:
        at = open_.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = v[at]
        half = len(at) // 2
        order = np.argpartition(x[:, np.argmax(x.max(axis=0) - x.min(axis=0))], half)
        open_ += [at[order[half:]], at[order[:half]]]
    return [a for a in out if len(a)]


def _boxes(v: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([v[a].min(axis=0) for a in leaves]), np.stack([v[a].max(axis=0) for a in leaves])


def _reach(unit: np.ndarray, d2: np.ndarray, weight: np.ndarray, need: int, n: int) -> np.ndarray:
    """For each of ``n`` units the least squared distance within which ``need`` rows were found, or infinity."""
    out = np.full(n, np.inf if need else -np.inf)
    if not need or not len(unit):
        return out
    order = np.lexsort((d2, unit))
    u, w = unit[order], np.cumsum(weight[order])
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
    before = np.repeat(np.r_[0, w][first], np.diff(np.r_[first, len(u)]))
    enough = np.flatnonzero(w - before >= need)
    hit, at = np.unique(u[enough], return_index=True)
    out[hit] = d2[order][enough[at]]
    return out


def nearest_of(qv: np.ndarray, code, bounds: np.ndarray, cells: Cells, metric: Metric, part, n_same: int, n_all: int):
    """Of units of one label: (unit, row, distance) of each unit's ``n_same`` nearest rows of its label and ``n_all`` nearest
    rows, as far as they lie within its ``bounds`` (units x 2: squared distances for all rows and for its label's); and the bounds
    that hold then."""
    cats = list(metric.categories)
    w_all, w_same = cells.weights(None), cells.weights(code)
    qx, cx = (np.delete(v, cats, axis=1) for v in (qv, cells.v)) if cats else (qv, cells.v)
    middle = cx.mean(axis=0)  # nearer to the origin, less is lost to rounding
    qx, cx = qx - middle, cx - middle
    q2, c2 = (qx * qx).sum(axis=1), (cx * cx).sum(axis=1)
    left = np.column_stack([qx, q2, np.ones(len(qx))])
    right = np.column_stack([-2 * cx, np.ones(len(cx)), c2])
    slack = SLACK * 1e-3 * (1 + q2.max(initial=0.0) + c2.max(initial=0.0))
    leaves = leaves_of(cx, LEAF)
    low, high = _boxes(cx, leaves)
    size = np.array([len(a) for a in leaves])
    bounds, found = bounds.copy(), []
    for g in leaves_of(qx, GROUP):
        gap = np.maximum(0.0, np.maximum(low - qx[g].max(axis=0), qx[g].min(axis=0) - high))
        far = (gap * gap).sum(axis=1)
        order, bound = np.argsort(far, kind="stable"), bounds[g]
        unit, cell, d2 = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
        step = STEP // 4  # a first bound from few leaves
        while len(order):
            limit = bound * (1 + SLACK) + slack
            order = order[far[order] <= limit.max()]
            take = max(1, int(np.searchsorted(np.cumsum(size[order]), step)))
            some, order, step = order[:take], order[take:], STEP
            if not len(some):
                break
            at = np.concatenate([leaves[i] for i in some])
            d = left[g] @ right[at].T
            for c in cats:
                d += metric.penalty[part] * (qv[g, c][:, None] != cells.v[at, c][None, :])
            if np.isinf(limit).any():
                # too many are within no bound: as many cells as can be needed hold enough rows
                for i, (need, w) in enumerate(((n_all, w_all[at]), (n_same, w_same[at]))):
                    mine = np.flatnonzero(w > 0)
                    if need and len(mine) >= need:
                        kth = np.partition(d if len(mine) == len(at) else d[:, mine], need - 1, axis=1)[:, need - 1]
                        bound[:, i] = np.minimum(bound[:, i], kth)
                limit = bound * (1 + SLACK) + slack
            hit = np.flatnonzero(d <= limit.max(axis=1)[:, None])
            u, k = np.divmod(hit, len(at))
            d = d.ravel()[hit]
            wanted = (d <= limit[u, 0]) | ((d <= limit[u, 1]) & (w_same[at[k]] > 0))
            u, k, d = u[wanted], k[wanted], d[wanted]
            if not len(u):
                continue
            unit, cell, d2 = np.r_[unit, u], np.r_[cell, at[k]], np.r_[d2, d]
            same = w_same[cell] > 0
            bound = np.minimum(bound, np.column_stack([
                _reach(unit, d2, w_all[cell], n_all, len(g)), _reach(unit[same], d2[same], w_same[cell[same]], n_same, len(g))]))
            limit = bound * (1 + SLACK) + slack
            keep = (d2 <= limit[unit, 0]) | ((d2 <= limit[unit, 1]) & same)
            unit, cell, d2 = unit[keep], cell[keep], d2[keep]
        bounds[g] = bound
        found.append((g[unit], cell))
    unit, cell = (np.concatenate([f[i] for f in found]) for i in range(2)) if found else (np.zeros(0, "int64"),) * 2
    dist = metric.distance(qv[unit], cells.v[cell], part)
    n = w_all[cell]
    row = np.repeat(cells.ends[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    unit, dist = np.repeat(unit, n), np.repeat(dist, n)
    order = np.lexsort((cells.code[row] != code, cells.id[row], dist, unit))
    unit, row, dist = unit[order], row[order], dist[order]
    keep = _first(unit, n_all)
    mine = np.flatnonzero(cells.code[row] == code)
    keep[mine[_first(unit[mine], n_same)]] = True
    return unit[keep], row[keep], dist[keep], bounds


def _first(unit: np.ndarray, n: int) -> np.ndarray:
    """Whether an entry is among the first ``n`` of its unit; units come one after the other."""
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, "int64")
    return np.arange(len(unit)) - np.repeat(start, np.diff(np.r_[start, len(unit)])) < n


_FOUND = "cell long, code int, nid long, dist double, same boolean"
_FOUND_ARROW = pa.schema([("cell", pa.int64()), ("code", pa.int32()), ("nid", pa.int64()), ("dist", pa.float64()), ("same", pa.bool_())])


def _searched(cell: np.ndarray, qv: np.ndarray, code: np.ndarray, bounds: np.ndarray, cells: Cells, metric: Metric, part,
              n_same: int, n_all: int) -> tuple[pa.Table, np.ndarray]:
    """``nearest_of`` for the units of every label: rows of ``_FOUND`` and the bounds."""
    out, bounds = [], bounds.copy()
    for c in np.unique(code):
        at = np.flatnonzero(code == c)
        unit, row, dist, bounds[at] = nearest_of(qv[at], c, bounds[at], cells, metric, part, n_same, n_all)
        out.append(pa.table([cell[at][unit], np.full(len(unit), c, "int32"), cells.id[row], dist, cells.code[row] == c],
                            schema=_FOUND_ARROW))
    return pa.concat_tables(out) if out else _FOUND_ARROW.empty_table(), bounds


def search(rows: DataFrame, k_same: int, k_all: int = 0, metric: Metric | None = None, block_rows: int | None = None) -> Neighbours:
    """Neighbours of the rows with ``query`` among all ``rows(id, part, label, v, query)`` of equal ``part``.

    Each query gets its ``k_same`` nearest rows of its own label and its ``k_all``
    nearest of any, rows of its own id excluded; ties go to the smaller id.
    ``v`` is an array of doubles of one length, without nulls, ``id`` has no nulls.
    """
    metric = metric or Metric()
    held = cut_lineage(rows.select(
        F.col("id").cast("long").alias("id"), "part", "label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "query"))  # -0.0 is 0.0
    spark = held.sparkSession
    counted = held.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes: dict = {}
    for r in counted:
        sizes[r["part"]] = sizes.get(r["part"], 0) + r["n"]
    first = held.select(F.size("v").alias("d")).first()
    empty = "qid long, nid long, dist double, same boolean, rank_same int, rank_all int"
    if first is None:
        return Neighbours(spark.createDataFrame([], empty), 0, 0, 0)
    if block_rows is None:
        least = max(256, BLOCK_BYTES // (8 * max(1, first["d"])))
        block_rows = max(least, min(-(-sum(sizes.values()) // BLOCKS), WIDEN * least))
    # rows of a query's id are among what its cell finds: so many more are looked for
    copies = held.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    n_same, n_all = (k + copies if k else 0 for k in (k_same, k_all))
    codes = {x: i for i, x in enumerate(dict.fromkeys(r["label"] for r in counted if r["label"] is not None))}
    code = F.lit(-1)  # a row without a label is of no query's label
    for x, i in codes.items():
        code = F.when(F.col("label") == F.lit(x), F.lit(i)).otherwise(code)
    held = held.select("id", "part", "v", "query", code.alias("code"), F.xxhash64("part", "v").alias("h"))
    least_ids = F.row_number().over(Window.partitionBy("h", "part", "v", "code", "query").orderBy("id"))
    cells = (held.withColumn("n", least_ids).where(F.col("n") <= max(n_same, n_all)).groupBy("h", "part", "v")
             .agg(F.collect_list(F.struct("id", "code")).alias("rows"), F.collect_set(F.when(F.col("query"), F.col("code"))).alias("asked")))
    cells = cut_lineage(cells.withColumn("cell", F.monotonically_increasing_id()))
    share = min(1.0, MAX_CENTRES / sum(-(-n // block_rows) for n in sizes.values()))
    centres: dict = {}
    for p, n in sizes.items():  # a part is a class: a few
        want = max(1, int(share * -(-n // block_rows)))
        got = cells.where(F.col("part").eqNullSafe(F.lit(p))).orderBy(F.xxhash64("h", F.lit(7)), "h", "v").limit(want).select("v").collect()
        centres[p] = np.unique(np.array([r["v"] for r in got], dtype="float64"), axis=0)
    base, at = {}, 0
    for p, c in centres.items():
        base[p], at = at, at + len(c)

    def assign(batches):
        for batch in batches:
            centre, reach = np.zeros(batch.num_rows, "int32"), np.zeros(batch.num_rows)
            parts, v = np.array(batch.column("part").to_pylist(), dtype=object), _matrix(batch.column("v"))
            for p, c in centres.items():
                mine = np.flatnonzero([x == p for x in parts])
                step = max(1, CELLS // len(c))
                for some in (mine[lo:lo + step] for lo in range(0, len(mine), step)):
                    best = metric.squared(v[some], c, p).argmin(axis=1)
                    centre[some], reach[some] = base[p] + best, metric.distance(v[some], c[best], p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre), pa.array(reach)], names=[*batch.schema.names, "centre", "reach"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema.fields)
    assigned = cut_lineage(cells.mapInArrow(assign, kind + ", centre int, reach double"))
    drawn = {r["centre"]: r["n"] for r in assigned.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect()}
    deal, number = [], 0
    for centre, n in sorted(drawn.items()):
        deal.append((centre, number, -(-n // block_rows)))
        number += deal[-1][2]
    laid = assigned.join(F.broadcast(spark.createDataFrame(deal, "centre int, first int, parts int")), "centre").withColumn(
        "b", F.col("first") + F.pmod(F.xxhash64("h", F.lit(11)), F.col("parts")).cast("int")).drop("first", "parts")
    blocks = laid.groupBy("b").agg(F.first("centre").alias("centre"), F.min("reach").alias("least"), F.max("reach").alias("most")).collect()
    part_of = [p for p, c in centres.items() for _ in range(len(c))]
    info = {p: [(r["b"], r["centre"] - base[p], r["least"], r["most"]) for r in blocks if part_of[r["centre"]] == p] for p in centres}
    info = {p: tuple(np.array(x) for x in zip(*v)) for p, v in info.items()}
    part_in = {r["b"]: part_of[r["centre"]] for r in blocks}

    def needs(v: np.ndarray, bound: np.ndarray, p) -> tuple[np.ndarray, np.ndarray]:
        """(block numbers, queries x blocks: whether the block can hold a neighbour)."""
        b, centre, least, most = info[p]
        d = np.sqrt(metric.squared(v, centres[p], p))[:, centre]
        low = np.maximum(d - most, least - d)
        return b, low <= (bound * (1 + SLACK) + SLACK * (1 + d.max(initial=0.0)))[:, None]

    units = laid.select("cell", "v", "b", F.explode("asked").alias("code"))

    def own(table: pa.Table) -> pa.Table:
        """Rows found, a row with the bounds for each unit, and one that tells which blocks to visit."""
        b = table.column("b")[0].as_py()
        p, cells = part_in[b], Cells.of(table)
        asked = _array(table.column("asked"))
        at, code = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy(zero_copy_only=False)
        cell, v = table.column("cell").to_numpy()[at], cells.v[at]
        found, bounds = _searched(cell, v, code, np.tile([np.inf if n_all else -np.inf, np.inf if n_same else -np.inf], (len(at), 1)),
                                  cells, metric, p, n_same, n_all)
        seen, radius = np.zeros(len(info[p][0]), dtype=bool), np.sqrt(bounds.max(axis=1, initial=0.0))
        step = max(1, CELLS // max(1, len(seen)))
        for lo in range(0, len(at), step):
            seen |= needs(v[lo:lo + step], radius[lo:lo + step], p)[1].any(axis=0)
        visits = [int(x) for x in info[p][0][seen] if x != b]
        none = lambda n, t: pa.nulls(n, t)
        f, u = found.num_rows, len(at)
        kinds = [*_FOUND_ARROW.types, pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
        names = [*_FOUND_ARROW.names, "b", "to_all", "to_same", "visits"]
        parts = [[*found.columns, *[none(f, t) for t in kinds[5:]]],
                 [cell, code.astype("int32"), none(u, kinds[2]), none(u, kinds[3]), none(u, kinds[4]), np.full(u, b, "int32"), bounds[:, 0], bounds[:, 1], none(u, kinds[8])],
                 [*[none(1, t) for t in kinds[:5]], [b], *[none(1, t) for t in kinds[6:8]], [visits]]]
        schema = pa.schema(list(zip(names, kinds)))
        return pa.concat_tables([pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(x, kinds)], schema=schema) for x in parts])

    first_pass = cut_lineage(laid.groupBy("b").applyInArrow(own, f"{_FOUND}, b int, to_all double, to_same double, visits array<int>"))
    pairs = first_pass.where("visits is not null").select(F.col("b").alias("qb"), F.explode("visits").alias("cb"))
    visited = pairs.count()

    def between(key, q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _FOUND_ARROW.empty_table()
        cb = key[1].as_py()
        p, v = part_in[cb], _matrix(q.column("v"))
        bounds = np.column_stack([q.column(n).to_numpy() for n in ("to_all", "to_same")])
        names, need = needs(v, np.sqrt(np.maximum(bounds.max(axis=1), 0.0)), p)
        use = np.flatnonzero(need[:, list(names).index(cb)])
        cell, code = (q.column(n).to_numpy()[use] for n in ("cell", "code"))
        return _searched(cell, v[use], code, bounds[use], Cells.of(c), metric, p, n_same, n_all)[0]

    near = first_pass.where("nid is not null").select("cell", "code", "nid", "dist", "same")
    if visited:
        bounds = first_pass.where("to_all is not null").select("cell", "code", "to_all", "to_same")
        queries = units.join(bounds, ["cell", "code"]).withColumnRenamed("b", "qb").join(pairs, "qb")
        candidates = laid.select(*[F.col(c).alias(c) for c in ("v", "rows")], F.col("b").alias("cb")).join(
            pairs.select(F.col("qb").alias("qb"), F.col("cb").alias("cb")), "cb")
        near = near.unionByName(queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(between, _FOUND))

    def ranked(frame: DataFrame, of: list, to_same: int, to_all: int) -> DataFrame:
        """``rank_same`` and ``rank_all`` up to the limits, rows beyond both left out."""
        order = [F.col("dist"), F.col("nid"), F.desc("same")]
        rank_all, rank_same = (F.row_number().over(Window.partitionBy(*of, *more).orderBy(*order)) for more in ([], ["same"]))
        out = frame.withColumn("rank_all", rank_all).withColumn("rank_same", F.when(F.col("same"), rank_same))
        return (out.withColumn("rank_same", F.when(F.col("rank_same") <= to_same, F.col("rank_same")))
                .withColumn("rank_all", F.when(F.col("rank_all") <= to_all, F.col("rank_all")))
                .where("rank_same is not null or rank_all is not null"))

    lists = (ranked(near, ["cell", "code"], n_same, n_all).groupBy("cell", "code")
             .agg(F.collect_list(F.struct("nid", "dist", "same")).alias("near")))
    of_rows = cells.select("cell", "h", F.col("part").alias("cpart"), F.col("v").alias("cv")).join(lists, "cell")
    asking = held.where("query").withColumnRenamed("id", "qid")
    asking = asking.join(of_rows, (asking["h"] == of_rows["h"]) & (asking["code"] == of_rows["code"])
                         & asking["part"].eqNullSafe(of_rows["cpart"]) & (asking["v"] == of_rows["cv"]))
    if copies > 1:
        # query rows of one id are one query: each of them counts what all of them find
        again = held.where("query").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("times")).where("times > 1")
        if not again.isEmpty():
            times = again.select(F.col("id").alias("rid"), "times")
            asking = asking.join(times, asking["qid"] == times["rid"], "left").withColumn(
                "near", F.flatten(F.array_repeat("near", F.coalesce("times", F.lit(1)))))
    each = asking.select("qid", F.explode("near").alias("n")).select("qid", "n.*").where(F.col("nid") != F.col("qid"))
    frame = ranked(each, ["qid"], k_same, k_all).select("qid", "nid", "dist", "same", "rank_same", "rank_all")
    return Neighbours(frame, len(blocks), sum(len(v[0]) ** 2 for v in info.values()), visited + len(blocks))
