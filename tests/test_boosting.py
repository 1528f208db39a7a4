from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidemark.operators import boosting, learners


@pytest.fixture(scope="module")
def train(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("a"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("b"), (F.col("id") % 2).cast("double").alias("c"), F.lit(3.0).alias("d"))
    rows = rows.withColumn("y_true", F.col("a") * 10 + F.sqrt("b") * 30 + F.col("c") * F.col("b") / 5 + F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(97)) / 9.7)
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(rows)


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("row_id").collect()])


def spark_booster(**params):
    return GBTRegressor(labelCol="y_true", stepSize=0.05, minInstancesPerNode=40, seed=42, **params)


@pytest.mark.parametrize("max_bins", [20, 255])
def test_boosting_is_the_one_of_spark(train, max_bins):
    own = learners.boosted_trees(max_iter=4, max_depth=4, max_bins=max_bins).fit(train)
    theirs = spark_booster(maxIter=4, maxDepth=4, maxBins=max_bins).fit(train)
    assert own.getNumTrees == theirs.getNumTrees and own.treeWeights == theirs.treeWeights
    np.testing.assert_allclose(predicted(own, train), predicted(theirs, train), rtol=1e-9)
    np.testing.assert_allclose(own.evaluateEachIteration(train, "squared"), theirs.evaluateEachIteration(train, "squared"), rtol=1e-9)
    np.testing.assert_allclose(own.featureImportances.toArray(), theirs.featureImportances.toArray(), rtol=1e-6)


def test_early_stop_is_the_one_of_spark(train):
    marked = train.withColumn("_held_out", F.pmod(F.xxhash64(F.lit(42), "row_id"), F.lit(1 << 20)) < (1 << 18))
    own = learners.boosted_trees(max_iter=12, max_depth=3, validation_fraction=0.25, tol=0.2).fit(train)
    theirs = spark_booster(maxIter=12, maxDepth=3, maxBins=255, validationIndicatorCol="_held_out", validationTol=0.2).fit(marked)
    assert own.getNumTrees == theirs.getNumTrees < 12
    np.testing.assert_allclose(predicted(own, train), predicted(theirs, train), rtol=1e-9)


def test_small_blocks_slices_and_rebuilt_residuals_give_the_same_model(train, monkeypatch):
    learner = learners.boosted_trees(max_iter=4, max_depth=3)
    whole = learner.fit(train)
    for name, small in (("BLOCK_ROWS", 100), ("REBUILD_ROUNDS", 2), ("HISTOGRAM_BYTES", 16 * 600), ("SLICE_CELLS", 8), ("DRIVER_BYTES", 0), ("BUNDLED_FEATURES", 0), ("TASK_BYTES", 0)):
        monkeypatch.setattr(boosting, name, small)
    cut = learner.fit(train.repartition(3))
    np.testing.assert_allclose(predicted(cut, train), predicted(whole, train), rtol=1e-9)


def test_shuffled_and_driver_sums_are_those_of_one_task(train, monkeypatch):
    learner = learners.boosted_trees(max_iter=2, max_depth=3)
    whole = learner.fit(train)
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    np.testing.assert_allclose(predicted(learner.fit(train), train), predicted(whole, train), rtol=1e-9)


def test_a_small_table_takes_a_job_for_many_rounds(spark, train):
    context = spark.sparkContext
    context.setJobGroup("rounds", "")
    try:
        learners.boosted_trees(max_iter=40, max_depth=2).fit(train)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("rounds")) < 40


def test_rounds_of_several_jobs_are_those_of_one(train, monkeypatch):
    plain = learners.boosted_trees(max_iter=7, max_depth=3)
    stopped = learners.boosted_trees(max_iter=12, max_depth=3, validation_fraction=0.25, tol=0.2)
    whole, early = plain.fit(train), stopped.fit(train)
    monkeypatch.setattr(boosting, "JOB_ROUNDS", 3)
    np.testing.assert_allclose(predicted(plain.fit(train), train), predicted(whole, train), rtol=1e-9)
    again = stopped.fit(train)
    assert again.getNumTrees == early.getNumTrees < 12
    np.testing.assert_allclose(again.featureImportances.toArray(), early.featureImportances.toArray(), rtol=1e-9)


def test_boosting_leaves_no_residuals_cached(spark, train):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = learners.boosted_trees(max_iter=3, max_depth=3).fit(train)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert max(len(t.left) for t, _ in model.trees) == 15


def test_boosting_refuses_missing_labels_and_no_rows(train):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="labels"):
        learners.boosted_trees(max_iter=1).fit(train.withColumn("y_true", F.when(F.col("row_id") != 5, F.col("y_true"))))
    with pytest.raises(ValueError, match="no rows"):
        learners.boosted_trees(max_iter=1).fit(train.where("row_id < 0"))
