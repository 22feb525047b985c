"""The grid search fits each point once a fold and nothing else; deep forests keep each row's node."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from quire.operators import train as TR


@pytest.fixture(scope="module")
def folds(spark):
    return spark.range(360, numPartitions=3).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") / 2).cast("int") % 3).alias("fold"),
        ((F.col("id") * 7) % 11 + F.col("id") % 2).cast("double").alias("x"), ((F.col("id") * 5) % 13).cast("double").alias("z")).cache()


def test_scores_are_those_of_the_cross_validator_in_as_many_fits_as_points_and_folds(folds, monkeypatch):
    cfg = TR.ModelConfig(n_estimators=[3, 5], max_depth=[2, 7], min_samples_split=[2, 6], n_folds=3, cost_weight={0: 1, 1: 3})
    fits, plain = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: fits.append(self.getWeightCol()) or plain(self, d))
    best, grid = TR.grid_search(folds, ["x", "z"], "y", cfg)
    monkeypatch.undo()
    assert len(grid) == 16 and {w: fits.count(w) for w in set(fits)} == {"w_bal": 24, "w_cost": 24}
    assert best[1] == max(s for _, s in grid)
    data = TR.assemble(TR.with_class_weight(folds, "y", {0: 1, 1: 3}, "w_cost"), ["x", "z"])
    rf = TR.forest("y", weight="w_cost")
    points = ParamGridBuilder().addGrid(rf.numTrees, [3, 5]).addGrid(rf.maxDepth, [2, 7]).addGrid(rf.minInstancesPerNode, [1, 3]).build()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=points, evaluator=TR.scorer("f1", "y"), numFolds=3, foldCol="fold").fit(data)
    want = [({p.name: v for p, v in pm.items()} | {"weight": "w_cost"}, s) for pm, s in zip(points, cv.avgMetrics)]
    got = [g for g in grid if g[0]["weight"] == "w_cost"]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_folds_out_of_range_or_empty_are_refused(folds):
    for n in (2, 4):
        with pytest.raises(ValueError):
            TR.grid_search(folds, ["x", "z"], "y", TR.ModelConfig(n_estimators=[2], max_depth=[2], min_samples_split=[2], n_folds=n))


def test_deep_forests_keep_nodes_and_have_the_same_trees(folds):
    data = TR.assemble(folds, ["x", "z"])
    assert not TR.forest("y", depth=5).getCacheNodeIds()
    deep = TR.forest("y", 4, 9, weight=None)
    assert deep.getCacheNodeIds() and TR.forest("y").getCacheNodeIds()
    trees = [m.toDebugString.split("\n", 1)[1] for m in (deep.fit(data), deep.copy({deep.cacheNodeIds: False}).fit(data))]
    assert trees[0] == trees[1]
