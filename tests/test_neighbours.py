"""The metric partition index against comparing all rows, and what SMOTE makes of it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import resample as R
from quire.operators.neighbours import Metric, search

RNG = np.random.default_rng(17)


def clustered(n_clusters=12, each=50, d=6):
    x = np.concatenate([c + RNG.normal(size=(each, d)) for c in RNG.normal(size=(n_clusters, d)) * 20])
    x[5] = x[6] = x[7]  # equal rows: ties go to the smaller id
    return x, RNG.integers(0, 3, len(x))


def plain(x, label, queries, k_same, k_all, categories=(), penalty=None, within=None):
    out, rest = {}, [c for c in range(x.shape[1]) if c not in categories]
    for i in queries:
        d2 = ((x[:, rest] - x[i, rest]) ** 2).sum(axis=1)
        for c in categories:
            d2 = d2 + penalty * (x[:, c] != x[i, c])
        order = [j for j in np.lexsort((np.arange(len(x)), np.sqrt(d2))) if j != i and (within is None or within[j] == within[i])]
        out[i] = [j for j in order if label[j] == label[i]][:k_same], order[:k_all]
    return out


def check(frame, want):
    got = frame.toPandas()
    by = {i: g for i, g in got.groupby("qid")}
    for i, (same, every) in want.items():
        g = by.get(i, got.head(0))
        assert g.dropna(subset=["rank_same"]).sort_values("rank_same").nid.tolist() == same
        assert g.dropna(subset=["rank_all"]).sort_values("rank_all").nid.tolist() == every
    assert set(by) <= set(want)


def frame(spark, x, label, part=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "part": part, "label": label, "v": list(x), "query": label < 2}))


@pytest.mark.parametrize("block_rows", [None, 40])
def test_search_equals_comparing_all_rows(spark, block_rows):
    x, label = clustered()
    found = search(frame(spark, x, label), 3, 5, block_rows=block_rows)
    check(found.frame, plain(x, label, np.flatnonzero(label < 2), 3, 5))
    if block_rows:
        assert found.blocks > 10 and found.visited < 0.75 * found.pairs  # most far blocks are never compared


def test_search_without_structure_and_with_hot_centre(spark):
    x, label = RNG.normal(size=(200, 30)), RNG.integers(0, 3, 200)  # nothing can be pruned
    check(search(frame(spark, x, label), 2, 4, block_rows=30).frame, plain(x, label, np.flatnonzero(label < 2), 2, 4))
    x[:150] = 1.0  # most rows equal: one centre, several blocks
    found = search(frame(spark, x, label), 2, 4, block_rows=30)
    assert found.blocks >= 7
    check(found.frame, plain(x, label, np.flatnonzero(label < 2), 2, 4))


def test_mixed_distance_within_classes(spark):
    x, label = clustered()
    x[:, 0], x[:, 1] = RNG.integers(0, 3, len(x)), RNG.integers(0, 2, len(x))
    penalties = {0: 4.0, 1: 9.0, 2: 1.0}
    found = search(frame(spark, x, label, part=label), 3, 0, Metric((0, 1), penalties), block_rows=25)
    for c in (0, 1):
        ids = np.flatnonzero(label == c)
        want = plain(x, label, ids, 3, 0, (0, 1), penalties[c], label)
        check(found.frame.where(F.col("qid").isin(ids.tolist())), want)


def test_penalty_is_half_the_squared_median_spread(spark):
    x, label = clustered(4, 30, 5)
    rows = frame(spark, x, label).select("label", "v")
    got = R.category_penalties(rows, [0, 1], (0, 3))
    for c in (0, 1):
        assert got[c] == pytest.approx(np.median(x[label == c][:, [1, 2, 4]].std(axis=0)) ** 2 / 2)


def test_few_rows(spark):
    one = spark.createDataFrame([(1, 0, 0, [1.0], True)], "id long, part int, label int, v array<double>, query boolean")
    assert search(one, 3, 3).frame.count() == 0 and search(one.limit(0), 3).frame.count() == 0
    two = one.unionByName(spark.createDataFrame([(2, 0, 1, [1.0], False)], one.schema))
    assert [tuple(r) for r in search(two, 3, 3).frame.collect()] == [(1, 2, 0.0, False, None, 1)]


@pytest.mark.parametrize("method", ["smote", "smotenc", "adasyn", "borderline"])
def test_counts_and_segments(spark, method):
    n = 260
    x, y = RNG.normal(size=(n, 4)), (RNG.random(n) < 0.2).astype(int)
    x[:, 0] = RNG.integers(0, 3, n)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "label": y, "v": list(x)}))
    out = R.smote_family(df, "label", "id", "v", method, categorical_idx=(0,) if method == "smotenc" else (), block_rows=40).toPandas()
    made = out[out.synthetic]
    assert len(made) == (y == 0).sum() - (y == 1).sum() and (made.label == 1).all() and made.id.is_unique
    ids, rest = np.flatnonzero(y == 1), [0, 1, 2, 3] if method != "smotenc" else [1, 2, 3]
    pen = R.category_penalties(df.select("label", "v"), [1], (0,))[1] if method == "smotenc" else None
    near = plain(x, y, ids, 3, 0, (0,) if method == "smotenc" else (), pen, y)
    for v in made.v:
        v, fits = np.asarray(v), False
        for i in ids:  # on the segment from a seed to one of its three nearest
            for j in near[i][0]:
                d = x[j, rest] - x[i, rest]
                t = (v[rest] - x[i, rest]) @ d / max(d @ d, 1e-300)
                on = -1e-9 <= t <= 1 + 1e-9 and np.allclose(x[i, rest] + t * d, v[rest], atol=1e-9)
                values = [x[q, 0] for q in near[i][0]]
                fits |= on and (method != "smotenc" or v[0] == min(set(values), key=lambda z: (-values.count(z), z)))
        assert fits


def test_a_single_seed_draws_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "DRAWS", 7)
    df = spark.createDataFrame([(i, int(i < 2), [float(i), 0.0]) for i in range(60)], "id long, label int, v array<double>")
    out = R.smote_family(df, "label", "id", "v", "smote")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 58, 1: 58}
    assert out.select("id").distinct().count() == 116
