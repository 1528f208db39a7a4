"""Fit several learners on one matrix and judge them together."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.parsing import named
from tidemark.operators.learners import LABEL, Learner
from tidemark.operators.metrics import leaderboard, regression_metrics, wide_results
from tidemark.operators.policy import FeatureSpec
from tidemark.operators.prep import Preprocessor, fit_preprocessor
from tidemark.operators.temporal import SplitBounds, assign_split, year_column

#: Row attributes carried along so that diagnostics need no join.
ATTRIBUTES = ("history_date", "outcode_area", "propertyType")
#: Learners fitted at a time, beside one that keeps all cores busy.
CONCURRENT_FITS = 4


@dataclass
class Matrix:
    """Prepared rows of all splits with what is needed to read them."""

    rows: DataFrame
    prep: Preprocessor

    def of(self, *splits: str) -> DataFrame:
        return self.rows.where(F.col("split").isin(*splits))

    def release(self) -> None:
        self.rows.unpersist()


def prepare_matrix(
    clean: DataFrame, bounds: SplitBounds, spec: FeatureSpec, *, target: str = "history_price",
    attributes: Sequence[str] = ATTRIBUTES, rows: int | None = None,
) -> Matrix:
    """Fit preprocessing on the train rows and prepare every row once.

    ``rows`` may bound the table's size when the caller knows it.  The matrix
    is dealt evenly by row id, because small staged files would leave it in
    one partition, and persisted, because tree learners read it once per
    level; a lost block is recomputed from the staged clean table.
    """
    split = assign_split(clean, bounds)
    prep = fit_preprocessor(clean.where(bounds.rows_of("train", year=year_column(clean))), spec, rows=rows)
    kept = [named(c) for c in attributes if c in clean.columns]
    prepared = prep.transform(split).select("row_id", "split", *kept, named(target).alias(LABEL), "features")
    even = prepared.repartition(even_partitions(prepared), "row_id")
    return Matrix(even.persist(StorageLevel.MEMORY_AND_DISK), prep)


def even_partitions(df: DataFrame) -> int:
    """At least one partition for each core, and no fewer than the scan would have."""
    return max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())


def fit_all(train: DataFrame, learners: Sequence[Learner], feature_dim: int):
    """Fitted models by name, and the reason for each learner left out.

    Several learners are fitted at a time: most leave cores idle, between the jobs of their
    rounds or all through a fit.  Those that keep all cores busy take turns.
    """
    def attempt(learner: Learner):
        reason = learner.skip_reason(feature_dim)
        if reason is None:
            try:
                return learner.fit(train), None
            except (AnalysisException, IllegalArgumentException, ValueError, ArithmeticError) as error:
                # A bad candidate must not end the run; a failed Spark job must.
                reason = f"{type(error).__name__}: {error}"
        return None, reason

    models, skipped = {}, {}
    with ThreadPoolExecutor(CONCURRENT_FITS) as pool, ThreadPoolExecutor(1) as turns:
        runs = [(turns if learner.wide else pool).submit(inheritable_thread_target(train.sparkSession)(attempt), learner) for learner in learners]
        try:
            for learner, run in zip(learners, runs, strict=True):
                model, reason = run.result()
                if reason is None:
                    models[learner.name] = model
                else:
                    skipped[learner.name] = reason
        finally:  # after a failure no further fit begins
            for run in runs:
                run.cancel()
    return models, skipped


def score_models(rows: DataFrame, models: Mapping[str, object]) -> DataFrame:
    """Long predictions of all models from a single pass over ``rows``."""
    if not models:
        kept = [f for f in rows.schema if f.name != "features"]
        return rows.sparkSession.createDataFrame([], T.StructType([
            *kept, T.StructField("model", T.StringType()), T.StructField("y_pred", T.DoubleType())]))
    wide = rows
    for i, model in enumerate(models.values()):
        wide = model.transform(wide).withColumnRenamed("prediction", f"p{i}")
    cells = [
        F.struct(F.lit(name).alias("model"), F.col(f"p{i}").cast("double").alias("y_pred"))
        for i, name in enumerate(models)]
    kept = [c for c in rows.columns if c != "features"]
    return wide.select(*kept, F.inline(F.array(*cells)))


def wide_predictions(
    predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = ("row_id", "split", "history_date", "y_true"),
) -> DataFrame:
    """One row per scored row with a ``pred_<model>`` column for each named model."""
    return predictions.groupBy(*keys).agg(*[
        F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(f"pred_{m}") for m in models])


def long_predictions(wide: DataFrame) -> DataFrame:
    """The inverse of :func:`wide_predictions`; a narrow projection."""
    scored = [c for c in wide.columns if c.startswith("pred_")]
    cells = [F.struct(F.lit(c.removeprefix("pred_")).alias("model"), named(c).alias("y_pred")) for c in scored]
    return wide.select(*[named(c) for c in wide.columns if c not in scored], F.inline(F.array(*cells)))


@dataclass
class Comparison:
    results: DataFrame
    predictions: DataFrame
    models: Mapping[str, object]
    skipped: Mapping[str, str]


def compare_models(matrix: Matrix, learners: Sequence[Learner]) -> Comparison:
    """Leaderboard and validation/test predictions of every learner that fits."""
    models, skipped = fit_all(matrix.of("train"), learners, matrix.prep.feature_dim)
    predictions = score_models(matrix.of("val", "test"), models)
    return Comparison(leaderboard(regression_metrics(predictions)), predictions, models, skipped)


def skipped_table(spark, skipped: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(skipped.items()), "model string, reason string")


# The settings tried for each family.
BOOSTING_GRID = [
    {"max_depth": 5, "learning_rate": 0.05, "max_iter": 120, "min_samples_leaf": 30},
    {"max_depth": 6, "learning_rate": 0.06, "max_iter": 140, "min_samples_leaf": 40},
    {"max_depth": 7, "learning_rate": 0.05, "max_iter": 160, "min_samples_leaf": 40},
    {"max_depth": 6, "learning_rate": 0.04, "max_iter": 180, "min_samples_leaf": 50},
    {"max_depth": 8, "learning_rate": 0.03, "max_iter": 220, "min_samples_leaf": 60},
    {"max_depth": 5, "learning_rate": 0.07, "max_iter": 120, "min_samples_leaf": 25},
]
FOREST_GRID = [
    {"n_estimators": 90, "max_depth": 18, "min_samples_leaf": 4},
    {"n_estimators": 120, "max_depth": 20, "min_samples_leaf": 4},
    {"n_estimators": 140, "max_depth": 22, "min_samples_leaf": 4},
    {"n_estimators": 120, "max_depth": 18, "min_samples_leaf": 3},
    {"n_estimators": 100, "max_depth": 16, "min_samples_leaf": 5},
    {"n_estimators": 140, "max_depth": 20, "min_samples_leaf": 5},
]


def parameter_grid(**choices: Sequence) -> list[dict]:
    """All combinations of the given parameter values."""
    return [dict(zip(choices, values)) for values in product(*choices.values())]


def grid_search(
    matrix: Matrix,
    families: Mapping[str, tuple[Callable[..., Learner], Sequence[Mapping]]],
    *,
    select_by: str = "val_rmse",
) -> DataFrame:
    """One row per setting, best first; a setting that can't be fitted keeps its row and reason.

    ``families`` maps a family name to its learner factory and settings.
    Ranking by validation error keeps the test split untouched; pass
    ``test_rmse`` to rank the way a test-selected search would.
    """
    trials = [
        (family, json.dumps(params, sort_keys=True), factory(f"trial_{family}_{i}", **params))
        for family, (factory, grid) in families.items() for i, params in enumerate(grid)]
    models, skipped = fit_all(matrix.of("train"), [t[2] for t in trials], matrix.prep.feature_dim)
    metrics = wide_results(regression_metrics(score_models(matrix.of("val", "test"), models)))
    spark = matrix.rows.sparkSession
    settings = spark.createDataFrame(
        [(learner.name, family, params, "failed" if learner.name in skipped else "fitted", skipped.get(learner.name))
         for family, params, learner in trials],
        "model string, model_family string, params string, status string, reason string")
    return settings.join(metrics, "model", "left").select(
        "model_family", "params", "val_mae", "val_rmse", "test_mae", "test_rmse", "status", "reason",
    ).orderBy(F.col(select_by).asc_nulls_last(), "model_family", "params")


def best_of_family(
    results: DataFrame, family_of: Mapping[str, str], score: str = "test_rmse"
) -> DataFrame:
    """``results`` plus the best member of each family again, under the family name."""
    family = F.element_at(F.create_map(*[F.lit(x) for pair in family_of.items() for x in pair]), F.col("model"))
    rank = F.row_number().over(Window.partitionBy("_family").orderBy(F.col(score).asc_nulls_last(), "model"))
    mirrors = (
        results.withColumn("_family", family).where("_family IS NOT NULL")
        .withColumn("_rank", rank).where("_rank = 1")
        .withColumn("model", F.col("_family")).drop("_family", "_rank"))
    return results.unionByName(mirrors)
