from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidemark.operators import forest, learners


def searched(bins, y, w, n_bins, depth, leaf):
    """Predictions of the tree that tries every split of every node."""
    out = np.zeros(len(y))

    def go(rows, level):
        weight, total = w[rows].sum(), (w[rows] * y[rows]).sum()
        best, sides = 1e-9, None
        for j, k in enumerate(n_bins if level < depth else []):
            for c in range(k - 1):
                left, right = rows[bins[j, rows] <= c], rows[bins[j, rows] > c]
                if min(w[left].sum(), w[right].sum()) >= leaf:
                    gain = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (left, right)) - total ** 2 / weight
                    if gain > best * (1 + 1e-9):
                        best, sides = gain, (left, right)
        if sides is None:
            out[rows] = total / weight
        else:
            for side in sides:
                go(side, level + 1)

    go(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_grown_tree_is_the_searched_one(seed):
    """Few cells, many cells and yes/no features are summed in three ways."""
    rng = np.random.default_rng(seed)
    n_bins = [2, 5, 60, 200, 1]
    bins = np.stack([rng.integers(0, k, 300) for k in n_bins]).astype(np.uint8)
    y, w = rng.normal(0, 1, 300) + bins[1], rng.integers(1, 4, 300).astype(np.uint8)
    nodes, gains = forest.grow(bins, y, w, n_bins, 8, 4)
    got = nodes.value[~nodes.left[nodes.reach(bins.T)]]
    np.testing.assert_allclose(got, searched(bins, y, w.astype(float), n_bins, 8, 4), atol=1e-9)
    assert gains[1] == gains.max() and gains[4] == 0


def test_a_constant_label_is_one_leaf():
    bins = np.arange(200, dtype=np.uint8)[None, :]
    nodes, gains = forest.grow(bins, np.full(200, 123456.789), np.ones(200, np.uint8), [200], 9, 1)
    assert len(nodes.left) == 1 and nodes.value[0] == pytest.approx(123456.789) and not gains.any()


@pytest.fixture(scope="module")
def train(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("b"), (F.col("id") % 2).cast("double").alias("c"))
    rows = rows.withColumn("y_true", F.col("a") * 10 + F.sqrt("b") * 30 + F.col("c") * F.col("b") / 5)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows)


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("row_id").collect()])


def test_large_nodes_many_shuffles_and_passes_give_the_same_forest(train, monkeypatch):
    learner = learners.random_forest(n_estimators=6, max_depth=6)
    whole = learner.fit(train)
    for name, small in (("GROUP_ROWS", 400), ("PASS_BYTES", 2000), ("READ_TREES", 2), ("DEALT_ROWS", 9000), ("BLOCK_ROWS", 500)):
        monkeypatch.setattr(forest, name, small)
    cut = learner.fit(train)
    assert len(whole.shares) == 1 and len(cut.shares) > 1
    np.testing.assert_allclose(predicted(cut, train), predicted(whole, train), rtol=1e-9)
    np.testing.assert_allclose(cut.featureImportances.toArray(), whole.featureImportances.toArray(), rtol=1e-9)


def test_forest_is_as_good_as_the_one_of_spark(train):
    def error(model):
        return model.transform(train).agg(F.sqrt(F.avg((F.col("prediction") - F.col("y_true")) ** 2))).first()[0]

    own = learners.random_forest(n_estimators=10, max_depth=8).fit(train)
    theirs = RandomForestRegressor(
        labelCol="y_true", numTrees=10, maxDepth=8, minInstancesPerNode=4, maxBins=255, seed=42,
        featureSubsetStrategy="all").fit(train)
    assert error(own) == pytest.approx(error(theirs), rel=0.1)
    np.testing.assert_allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.01)


def test_a_deep_forest_costs_what_its_rows_cost(train):
    """Full histograms of all these nodes would take tens of GB."""
    model = learners.random_forest(n_estimators=120, max_depth=20).fit(train)
    trees = [t for share in model.shares for t in share.value]
    assert len(trees) == 120 and min(len(t.value) for t in trees) > 100
    # Each leaf has the rows asked for, so no tree has more leaves than a fourth of its draws.
    assert max(len(t.value) for t in trees) < 3500 / 4


def test_forest_refuses_missing_labels(spark, train):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="labels"):
        learners.random_forest(n_estimators=1).fit(train.withColumn("y_true", F.when(F.col("row_id") != 5, F.col("y_true"))))
    with pytest.raises(ValueError, match="no rows"):
        learners.random_forest(n_estimators=1).fit(train.where("row_id < 0"))
