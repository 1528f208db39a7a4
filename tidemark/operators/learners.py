"""Distributed regressors behind one small interface.

A learner fits on a prepared matrix (``features``, ``y_true``) and returns a
model whose ``transform`` adds ``prediction``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.quantiles import exact_medians
from tidemark.operators.boosting import fit_boosted
from tidemark.operators.forest import fit_forest
from tidemark.operators.target import with_target_map

LABEL = "y_true"
#: Widest matrix Spark's one-pass normal equations accept; ``l-bfgs`` takes any width.
NORMAL_EQUATION_WIDTH = 4096


@dataclass(frozen=True)
class Learner:
    name: str
    fit: Callable[[DataFrame], object]
    max_dim: int | None = None
    #: Whether one fit keeps all cores busy, so that such fits run one after the other.
    wide: bool = False

    def skip_reason(self, feature_dim: int) -> str | None:
        if self.max_dim is not None and feature_dim > self.max_dim:
            return f"feature_dim={feature_dim} > {self.max_dim}"
        return None

    def named(self, name: str) -> Learner:
        return replace(self, name=name)


@dataclass(frozen=True)
class ConstantModel:
    value: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


def fit_naive_median(train: DataFrame, label: str = LABEL) -> ConstantModel:
    """Predicts the train median of the target everywhere."""
    return ConstantModel(exact_medians(train, [label])[label])


def naive_median(name: str = "NaiveMedian") -> Learner:
    return Learner(name, fit_naive_median)


def boosted_trees(
    name: str = "HistGBR", *, max_depth: int = 7, learning_rate: float = 0.05, max_iter: int = 160,
    min_samples_leaf: int = 40, max_bins: int = 255, seed: int = 42, max_dim: int | None = None,
    validation_fraction: float = 0.0, tol: float = 0.01, row_id: str = "row_id",
) -> Learner:
    """Boosting for ``max_iter`` rounds, or with early stopping when the caller asks for it.

    With ``validation_fraction`` that share of the train rows, chosen by a seeded hash of
    ``row_id``, is held out; training stops when a round no longer improves its error by
    ``tol`` (relative).
    """
    def fit(train: DataFrame):
        held_out = None
        if validation_fraction > 0:
            part = F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(1 << 20))
            train, held_out = train.withColumn("_held_out", part < int(validation_fraction * (1 << 20))), "_held_out"
        return fit_boosted(
            train, rounds=max_iter, max_depth=max_depth, learning_rate=learning_rate, min_samples_leaf=min_samples_leaf,
            max_bins=max_bins, seed=seed, label=LABEL, held_out=held_out, tol=tol)

    return Learner(name, fit, max_dim)


def random_forest(
    name: str = "RandomForest", *, n_estimators: int = 120, max_depth: int = 20, min_samples_leaf: int = 4,
    max_bins: int = 255, seed: int = 42, bootstrap: bool = True,
) -> Learner:
    def fit(train: DataFrame):
        return fit_forest(
            train, n_trees=n_estimators, max_depth=max_depth, min_samples_leaf=min_samples_leaf, max_bins=max_bins, seed=seed,
            bootstrap=bootstrap, label=LABEL)

    return Learner(name, fit, wide=True)


def walk_forward_forest(name: str = "RandomForest", **params) -> Learner:
    """The larger forest used for fold stability."""
    return random_forest(name, **({"n_estimators": 350, "max_depth": 24, "min_samples_leaf": 3} | params))


def feature_dim(df: DataFrame, features: str = "features") -> int:
    """Width of an assembled vector column, from its metadata."""
    return df.schema[features].metadata["ml_attr"]["num_attrs"]


def _linear(train: DataFrame, reg: Callable[[float, float], tuple[float, float]], max_iter: int, solver: str):
    """Fit with penalties given in label units.

    Spark penalises coefficients of the label divided by its deviation: the
    population one in the normal equations, the sample one in l-bfgs.  The
    caller chooses the solver, so coefficients never change with the width.
    """
    normal, width = solver == "normal", feature_dim(train)
    if normal and width > NORMAL_EQUATION_WIDTH:
        raise ValueError(f"solver='normal' takes {NORMAL_EQUATION_WIDTH} features, not {width}; pass solver='l-bfgs'")
    n, sd = train.agg(F.count(LABEL), (F.stddev_pop if normal else F.stddev_samp)(LABEL)).first()
    ridge, lasso = reg(n, sd or 0.0)
    total = ridge + lasso
    return LinearRegression(
        labelCol=LABEL, solver=solver, standardization=False, maxIter=max_iter,
        regParam=total, elasticNetParam=lasso / total if total else 0.0, tol=1e-9).fit(train)


def ridge(name: str = "Ridge", alpha: float = 1.0, max_iter: int = 1000, solver: str = "normal") -> Learner:
    """Squared error plus alpha times the squared norm of the coefficients."""
    return Learner(name, lambda train: _linear(train, lambda n, sd: (alpha * sd / n, 0.0), max_iter, solver))


def elastic_net(
    name: str = "ElasticNet", alpha: float = 0.001, l1_ratio: float = 0.2, max_iter: int = 2000,
    solver: str = "normal",
) -> Learner:
    """Half mean squared error plus mixed absolute and squared penalties."""
    return Learner(name, lambda train: _linear(
        train, lambda n, sd: (sd * alpha * (1 - l1_ratio), alpha * l1_ratio), max_iter, solver))


def mapped_target(learner: Learner, kind: str = "standard", guard: bool = False) -> Learner:
    """The learner trained on a transformed target (see ``TargetMap``)."""
    return replace(learner, fit=with_target_map(learner.fit, kind, LABEL, guard))


def default_learners() -> list[Learner]:
    return [naive_median(), boosted_trees(), random_forest(), ridge(), elastic_net()]


def assisted_learners() -> list[Learner]:
    return [boosted_trees("AssistedHistGBR", max_dim=None), random_forest("AssistedRandomForest")]


def score(model, df: DataFrame, output: str = "y_pred") -> DataFrame:
    """``df`` with the model's prediction; partition-wise inside the JVM."""
    return model.transform(df).withColumnRenamed("prediction", output)


def score_foreign(
    df: DataFrame, make_predict, output: str = "y_pred", batch_size: int = 4096, features: str = "features"
) -> DataFrame:
    """Score a model that is not a Spark model, in Arrow batches.

    ``make_predict`` runs once per Python worker and returns a function from a
    2-d numpy batch to predictions.
    """
    predict = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[[feature_dim(df, features)]])
    return df.withColumn(output, predict(vector_to_array(features)))
