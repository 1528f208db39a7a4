"""Target transforms around any Spark regressor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slack beyond the observed log range before a prediction is clipped.
LOG_PAD = 0.5


@dataclass(frozen=True)
class TargetMap:
    """A fitted forward and inverse map of the label."""

    kind: str
    mean: float = 0.0
    scale: float = 1.0

    def forward(self, y: Column) -> Column:
        if self.kind == "log":
            return F.log1p(y)
        return (y - F.lit(self.mean)) / F.lit(self.scale) if self.kind == "standard" else y

    def inverse(self, z: Column) -> Column:
        if self.kind == "log":
            return F.expm1(z)
        return z * F.lit(self.scale) + F.lit(self.mean) if self.kind == "standard" else z


def fit_target_map(train: DataFrame, kind: str = "standard", label: str = "y_true") -> TargetMap:
    """``standard`` is a z-score with population deviation; ``log`` is log1p."""
    if kind not in ("standard", "log", "none"):
        raise ValueError(f"unknown target transform: {kind}")
    if kind != "standard":
        return TargetMap(kind)
    mean, scale = train.agg(F.avg(label), F.stddev_pop(label)).first()
    return TargetMap(kind, mean, scale or 1.0)


@dataclass(frozen=True)
class MappedModel:
    """A regressor trained on the mapped label that predicts in label units."""

    model: object
    map: TargetMap
    clip: tuple[float, float] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        z = F.col("prediction")
        if self.clip is not None:
            z = clip_between(z, *self.clip)
        return self.model.transform(df).withColumn("prediction", self.map.inverse(z))


def with_target_map(
    fit: Callable[[DataFrame], object], kind: str = "standard", label: str = "y_true", guard: bool = False
) -> Callable[[DataFrame], MappedModel]:
    """Wrap a learner's fit so that it sees the mapped label.

    ``guard`` clips log predictions to the train range before the inverse.
    """

    def fit_mapped(train: DataFrame) -> MappedModel:
        target = fit_target_map(train, kind, label)
        model = fit(train.withColumn(label, target.forward(F.col(label))))
        return MappedModel(model, target, fit_log_range(train, label) if guard and kind == "log" else None)

    return fit_mapped


def clip_between(c: Column, lo: float, hi: float) -> Column:
    """Clip to literals; NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def fit_log_range(train: DataFrame, label: str = "y_true", pad: float = LOG_PAD) -> tuple[float, float]:
    """Log-space range of the train label, widened by ``pad`` on both sides."""
    lo, hi = train.agg(F.min(F.log1p(label)), F.max(F.log1p(label))).first()
    return lo - pad, hi + pad


def clip_log_prediction(
    df: DataFrame, log_range: tuple[float, float], column: str = "pred_log", output: str = "y_pred"
) -> DataFrame:
    """Back to label units without blow-up from extreme log predictions."""
    return df.withColumn(output, F.expm1(clip_between(F.col(column), *log_range)))
