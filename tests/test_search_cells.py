"""The neighbour search compares cells of equal vectors, leaf by leaf; the fits of all runs are sums taken in one pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import neighbours as N
from quire.operators import stats as S
from quire.plans import leakfree as L


def brute(v, ids, label, at, k_same, k_all):
    dist = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
    order = [j for j in np.lexsort((label != label[at], ids, dist)) if ids[j] != ids[at]]
    return [(ids[j], label[j] == label[at]) for j in order[:k_all]], [ids[j] for j in order if label[j] == label[at]][:k_same]


def test_equal_vectors_are_searched_once_and_ids_come_under_two_labels(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.r_[np.arange(900), np.arange(0, 900, 3)]  # every third id has a row of both labels, with equal vectors
    label = np.r_[np.zeros(900, int), np.ones(300, int)]
    v = rng.integers(-1, 2, (30, 5)).astype(float)[ids % 30]
    v[v == 0] *= np.where(rng.random((v == 0).sum()) < 0.5, -1.0, 1.0)  # -0.0 and 0.0 are one value
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "part": 0, "label": label, "v": list(v), "query": label == 1}))
    written, plain = [], N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda d: written.append(plain(d)) or written[-1])
    found = N.search(df, 3, 10, block_rows=7)
    laid = [d.count() for d in written if "reach" in d.columns]
    assert laid == [len(np.unique(v + 0.0, axis=0))]  # not 1,200 rows
    got = found.frame.toPandas()
    assert got.groupby("qid").size().index.tolist() == list(range(0, 900, 3))
    for i in range(900, 1200):
        g = got[got.qid == ids[i]]
        every, same = brute(v, ids, label, i, 3, 10)
        assert [tuple(x) for x in g.dropna(subset="rank_all").sort_values("rank_all")[["nid", "same"]].to_numpy()] == every
        assert g.dropna(subset="rank_same").sort_values("rank_same").nid.tolist() == same


@pytest.mark.parametrize("values", [2, 1000])
def test_leaves_and_bounds_leave_nothing_out(values):
    rng = np.random.default_rng(values)
    v = np.unique(rng.integers(0, values, (3000, 9)).astype(float), axis=0)
    n = len(v)
    rows = rng.integers(1, 4, n)
    ends = np.r_[0, np.cumsum(rows)]
    cells = N.Cells(v, ends, rng.permutation(ends[-1]), (rng.random(ends[-1]) < 0.2).astype(int))
    owner = np.repeat(np.arange(n), rows)
    units = np.unique(owner[cells.code == 1])
    bounds = np.full((len(units), 2), np.inf)
    bounds[::3] = 2.0 if values == 2 else 4e5  # of another block
    unit, row, dist, _ = N.nearest_of(v[units], 1, bounds, cells, N.Metric(), 0, 4, 11)
    for u in range(0, len(units), 7):
        d2 = ((v[owner] - v[units[u]]) ** 2).sum(axis=1)
        order = np.lexsort((cells.id, np.sqrt(d2)))
        order = order[d2[order] <= bounds[u, 0]]
        want = {*order[:11], *order[cells.code[order] == 1][:4]}
        mine = unit == u
        assert set(row[mine]) == want and np.allclose(dist[mine], np.sqrt(d2[row[mine]]))


def test_fits_of_all_runs_need_no_long_aggregation(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 400
    x, z = rng.normal(size=n), rng.exponential(size=n) ** 2
    fold = np.arange(n) % 4
    df = spark.createDataFrame([(float(a), float(b), 0.1, None if i % 9 == 0 else float(i % 5), None if f == 3 else int(f))
                                for i, (a, b, f) in enumerate(zip(x, z, fold))], "x double, z double, same double, gaps double, fold int").repartition(5)
    for name in ("skewness", "var_samp", "stddev_pop"):
        monkeypatch.setattr(F, name, lambda *a: pytest.fail("an aggregate for each column of each run"))
    prof, scaler = L.fit_runs(df, ["x", "z", "same", "gaps"], [0, 1, 2, L.WHOLE])
    monkeypatch.undo()
    for r in (0, 1, 2, L.WHOLE):
        seen = df.where("fold is not null" if r == L.WHOLE else f"fold <> {r}").drop("fold")
        want = S.profile(seen, seen.columns)
        fitted = S.fit_scaler(S.apply_outliers(seen, want, "median"), seen.columns)
        for c in ("x", "z", "gaps"):
            assert prof[L._cell(c, r)] == pytest.approx(want[c]) and scaler[L._cell(c, r)] == pytest.approx(fitted[c])
        assert prof[L._cell("same", r)]["var_samp"] == 0 and prof[L._cell("same", r)]["skewness"] is None


def test_moments_of_no_rows(spark):
    df = spark.createDataFrame([(None, 1.5)], "a double, b double")
    assert S.column_moments(df, ["a", "b"]) == {"a": (0, 0.0, 0.0, 0.0), "b": (1, 1.5, 0.0, 0.0)}
    for d in (df, df.limit(0)):
        assert S.fit_scaler(d, ["a", "b"], S.column_moments(d, ["a", "b"])) == S.fit_scaler(d, ["a", "b"])


def test_query_rows_of_one_id_are_one_query(spark):
    df = spark.createDataFrame([(i, 0, 1, [float(x)], True) for i, x in ((1, 0), (1, 0), (2, 1), (3, 2), (4, 4), (5, 8))],
                               "id long, part int, label int, v array<double>, query boolean")
    got = {(r["qid"], r["rank_same"]): r["nid"] for r in N.search(df, 3).frame.collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [2, 2, 2] and [got[2, k] for k in (1, 2, 3)] == [1, 1, 3]
    assert sorted({q for q, _ in got}) == [1, 2, 3, 4, 5]
