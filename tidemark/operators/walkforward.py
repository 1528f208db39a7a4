"""Stability of model families over expanding time folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import named
from tidemark.operators.compare import even_partitions, fit_all, score_models
from tidemark.operators.fold_states import fold_statistics
from tidemark.operators.learners import LABEL, Learner
from tidemark.operators.metrics import error_columns
from tidemark.operators.policy import FeatureSpec
from tidemark.operators.prep import build_preprocessor
from tidemark.operators.temporal import Fold, fold_support, year_column

#: Few small rows per fold and family.
FOLD_SCHEMA = "fold string, model_family string, train_rows bigint, val_rows bigint, rmse double"


def walk_forward(
    df: DataFrame,
    folds: Sequence[Fold],
    learners: Sequence[Learner],
    spec: FeatureSpec | None,
    *,
    target: str = "history_price",
    min_rows: int = 1000,
) -> DataFrame:
    """Validation RMSE per fold and family, preprocessing refitted on each fold.

    The driver only walks over the handful of folds; every fit and score is
    distributed, and each fold reads its rows through a date filter.  Without
    a ``spec`` the learners see no features (baselines).
    """
    spark = df.sparkSession
    supported = {r["fold"]: r for r in fold_support(df, folds, min_rows=min_rows).collect()}
    results = []
    folds = sorted((f for f in folds if f.fold in supported), key=lambda f: f.val_start)
    # The preprocessing statistics of all folds come from one set of scans.
    most = max((supported[f.fold]["train_rows"] for f in folds), default=0)
    fitted = fold_statistics(df, folds, spec, rows=most) if spec is not None and folds else [None] * len(folds)
    for fold, statistics in zip(folds, fitted, strict=True):
        support = supported[fold.fold]
        year = year_column(df)
        train, val = df.where(fold.train_rows(year=year)), df.where(fold.val_rows(year=year))
        dim = 0
        if spec is not None:
            prep = build_preprocessor(train, statistics.medians, statistics.scaler, statistics.modes, statistics.categories)
            train, val, dim = prep.transform(train), prep.transform(val), prep.feature_dim
        keys = [c for c in ("row_id",) if c in df.columns]  # early stopping holds rows out by their id
        columns = [named(target).alias(LABEL), *([*keys, "features"] if spec is not None else [])]
        train = train.select(*columns)
        if spec is not None:
            train = train.repartition(even_partitions(train), *(keys or [LABEL]))
            # Learners read the matrix many times; baselines read one column once or twice.
            train = train.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            models, skipped = fit_all(train, learners, dim)
            # A family that can't be fitted on a supported fold shows as a row without an error.
            results += [(fold.label, name, support["train_rows"], support["val_rows"], None) for name in skipped]
            if models:
                rmse = error_columns(F.col(LABEL), F.col("y_pred"))[1]
                scored = score_models(val.select(*columns), models).groupBy("model").agg(rmse.alias("rmse"))
                results += [
                    (fold.label, r["model"], support["train_rows"], support["val_rows"], r["rmse"])
                    for r in scored.collect()]
        finally:
            train.unpersist()
    if not results:
        raise ValueError("no fold produced a result")
    return spark.createDataFrame(results, FOLD_SCHEMA)


def family_stability(fold_metrics: DataFrame) -> DataFrame:
    """Each fold row with its family's mean, population deviation and variation.

    All three are NULL for a family that lacks the error of a fold.
    """
    family = Window.partitionBy("model_family")
    complete = F.count("rmse").over(family) == F.count(F.lit(1)).over(family)
    return fold_metrics.withColumns({
        "rmse_mean": F.when(complete, F.avg("rmse").over(family)),
        "rmse_std": F.when(complete, F.stddev_pop("rmse").over(family)),
    }).withColumn("cv_pct", F.lit(100.0) * F.col("rmse_std") / F.nullif(F.col("rmse_mean"), F.lit(0.0)))


def fold_winners(fold_metrics: DataFrame) -> DataFrame:
    """Family with the lowest RMSE in each fold; the smaller name wins a tie."""
    return fold_metrics.where("rmse IS NOT NULL").groupBy("fold").agg(
        F.min_by("model_family", F.struct("rmse", "model_family")).alias("winner"))


def folds_won(fold_metrics: DataFrame) -> DataFrame:
    """How many folds each family wins, also when it wins none."""
    wins = fold_winners(fold_metrics).groupBy(F.col("winner").alias("model_family")).agg(
        F.count("*").alias("folds_won"))
    families = fold_metrics.select("model_family").distinct()
    return families.join(wins, "model_family", "left").select(
        "model_family", F.coalesce("folds_won", F.lit(0)).alias("folds_won"))


