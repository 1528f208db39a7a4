"""Regression metrics over long prediction tables.

A prediction table has one row per (row_id, split, model) with ``y_true`` and
``y_pred``; every metric of every model comes from one partially aggregated
group-by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import named

METRICS = ("mae", "rmse", "r2", "mape", "within_10pct_rate")
BASELINE_MODEL = "NaiveMedian"


def error_columns(y: Column, p: Column) -> tuple[Column, Column]:
    """MAE and RMSE aggregates."""
    e = y - p
    return F.avg(F.abs(e)), F.sqrt(F.avg(e * e))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when matched, else 0.

    A single row has no R2.
    """
    e = y - p
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.count(y) > 1, F.coalesce(F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0)), constant))


def relative_error(y: Column, p: Column, eps: float) -> Column:
    """|error| / |y| on rows where |y| exceeds ``eps``, else NULL."""
    return F.when(F.abs(y) > F.lit(eps), F.abs((y - p) / y))


def regression_metrics(
    predictions: DataFrame, by: Sequence[str] = ("model", "split"), eps: float = 100.0
) -> DataFrame:
    """All metrics of every group in one pass; unscored rows are left out."""
    y, p = F.col("y_true"), F.col("y_pred")
    mae, rmse = error_columns(y, p)
    relative = relative_error(y, p, eps)
    near = F.when(relative.isNotNull(), (relative < F.lit(0.10)).cast("double"))
    return predictions.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_rows"), mae.alias("mae"), rmse.alias("rmse"), r2(y, p).alias("r2"),
        F.avg(relative).alias("mape"), F.avg(near).alias("within_10pct_rate"))


def with_uplift(
    results: DataFrame, baseline: str = BASELINE_MODEL, score: str = "test_rmse"
) -> DataFrame:
    """Percent by which each row's score undercuts the baseline row's."""
    naive = F.max(F.when(F.col("model") == baseline, F.col(score))).over(Window.partitionBy())
    uplift = F.lit(100.0) * (F.lit(1.0) - F.col(score) / F.nullif(naive, F.lit(0.0)))
    return results.withColumn(f"{score}_improvement_vs_naive_pct", uplift)


def wide_results(metrics: DataFrame, splits: Sequence[str] = ("val", "test")) -> DataFrame:
    """One row per model with a column per split and metric."""
    return metrics.groupBy("model").agg(*[
        F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in splits for m in METRICS])


def first_per_model(results: DataFrame, arrival: str) -> DataFrame:
    """The earliest row of each model name."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy(arrival))
    return results.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def leaderboard(
    metrics: DataFrame, baseline: str = BASELINE_MODEL, arrival: str | None = None
) -> DataFrame:
    """Models by test RMSE; with ``arrival``, repeated names keep their first run."""
    if arrival is not None:
        first = F.min(arrival).over(Window.partitionBy("model"))
        metrics = metrics.withColumn("_first", first).where(F.col(arrival) == F.col("_first")).drop("_first")
    return with_uplift(wide_results(metrics), baseline).orderBy(F.col("test_rmse").asc_nulls_last(), "model")


def error_by_year(predictions: DataFrame, date: str = "history_date") -> DataFrame:
    scored = predictions.where(F.col("y_pred").isNotNull()).withColumn("year", F.year(named(date)))
    rmse = error_columns(F.col("y_true"), F.col("y_pred"))[1]
    return scored.where("year IS NOT NULL").groupBy("model", "year").agg(rmse.alias("rmse"))


def attach_attributes(predictions: DataFrame, rows: DataFrame, columns: Sequence[str], row_id: str = "row_id"):
    """Row attributes next to predictions that were stored without them."""
    absent = [c for c in columns if c not in predictions.columns]
    if not absent:
        return predictions
    return predictions.join(rows.select(row_id, *[named(c) for c in absent]), row_id)


def segment_metrics(predictions: DataFrame, dims: Sequence[str], min_rows: int = 50) -> DataFrame:
    """Errors per model and segment value for several dimensions at once.

    The dimensions are unpivoted in the same stage as the partial aggregate,
    so a segment with most of the rows is combined before the shuffle.
    """
    cells = [
        F.struct(F.lit(d).alias("segment_type"), named(d).cast("string").alias("segment_value")) for d in dims]
    rows = predictions.where("y_true IS NOT NULL AND y_pred IS NOT NULL").select(
        "model", "y_true", "y_pred", F.inline(F.array(*cells)))
    mae, rmse = error_columns(F.col("y_true"), F.col("y_pred"))
    return (
        rows.where("segment_value IS NOT NULL")
        .groupBy("segment_type", "segment_value", "model")
        .agg(F.count("*").alias("n_rows"), mae.alias("mae"), rmse.alias("rmse"))
        .where(F.col("n_rows") >= min_rows)
        .withColumnRenamed("n_rows", "rows")
        .orderBy("model", "segment_type", "rmse", "segment_value"))


def benchmark_columns(
    df: DataFrame, columns: Sequence[str], target: str = "history_price", min_rows: int = 100
) -> DataFrame:
    """Third-party estimate columns judged against the target, best first.

    All columns are scored side by side in one aggregate, without multiplying
    rows.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        raise ValueError("none of the benchmark columns is in the table")
    y = named(target)
    wide = df.agg(*[
        measure.alias(f"{label}{i}")
        for i, c in enumerate(present)
        for label, measure in zip(
            ("n", "mae", "rmse"),
            (F.count(y - named(c)), *error_columns(y, named(c))), strict=True)])
    cells = [
        F.struct(F.lit(c).alias("benchmark"), F.col(f"n{i}").alias("test_rows_used"),
                 F.col(f"mae{i}").alias("test_mae"), F.col(f"rmse{i}").alias("test_rmse"))
        for i, c in enumerate(present)]
    rows = wide.select(F.inline(F.array(*cells)))
    return rows.where(F.col("test_rows_used") >= min_rows).orderBy("test_rmse", "benchmark")
