"""Residuals, plot samples and the binned classification view."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bands import bin_index
from tidemark.operators.profile import histogram

#: Hex digits of the hash compared with a threshold before sorting.
HASH_DIGITS = 15


def best_model(results: DataFrame, score: str = "test_rmse") -> str:
    """Name with the lowest score; a one-row driver read of a metric table."""
    row = results.where(F.col(score).isNotNull()).orderBy(score, "model").select("model").first()
    if row is None:
        raise ValueError("no scored model")
    return row[0]


def residuals(predictions: DataFrame, model: str) -> DataFrame:
    """One model's residuals; the name is a literal, so the scan can skip others."""
    return predictions.where(F.col("model") == model).withColumn(
        "residual", F.col("y_true") - F.col("y_pred"))


def residual_histogram(predictions: DataFrame, model: str, bins: int = 60) -> DataFrame:
    return histogram(residuals(predictions, model), F.col("residual"), bins)


def hash_sample(df: DataFrame, n: int, seed: int = 42, row_id: str = "row_id", rows: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same on every run and layout.

    Rows are ranked by a seeded hash of their id.  On large tables a hash
    threshold first removes nearly all rows, so that the final top-n merges a
    little more than ``n`` rows instead of ``n`` per task.
    """
    ranked = df.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string"))))
    rows = df.count() if rows is None else rows
    expected = n + 10 * math.sqrt(n) + 100
    if rows > 8 * expected:
        limit = format(int(expected / rows * 16 ** HASH_DIGITS), f"0{HASH_DIGITS}x")
        few = ranked.where(F.substring("_hash", 1, HASH_DIGITS) < limit)
        if few.count() >= n:
            ranked = few
    return ranked.orderBy("_hash", row_id).limit(n).drop("_hash")


def axis_limits(sample: DataFrame) -> DataFrame:
    """Common lower and upper limit of actual and predicted values."""
    return sample.agg(
        F.least(F.min("y_true"), F.min("y_pred")).alias("axis_min"),
        F.greatest(F.max("y_true"), F.max("y_pred")).alias("axis_max"))


def assign_bins(predictions: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Actual and predicted bin under the same edges."""
    return predictions.withColumns({
        "true_bin": bin_index(F.col("y_true"), edges),
        "pred_bin": bin_index(F.col("y_pred"), edges),
    })


def confusion(binned: DataFrame, n_bins: int) -> DataFrame:
    """Counts of every (true, predicted) cell, zeros included."""
    counts = binned.where("true_bin IS NOT NULL AND pred_bin IS NOT NULL").groupBy(
        "true_bin", "pred_bin").agg(F.count("*").alias("n"))
    cells = binned.sparkSession.range(n_bins * n_bins).select(
        F.expr(f"cast(id div {n_bins} as int)").alias("true_bin"),
        F.expr(f"cast(id % {n_bins} as int)").alias("pred_bin"))
    return cells.join(counts, ["true_bin", "pred_bin"], "left").select(
        "true_bin", "pred_bin", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(cells: DataFrame, n_bins: int) -> DataFrame:
    """One row per true bin and one column per predicted bin."""
    return cells.groupBy("true_bin").agg(*[
        F.sum(F.when(F.col("pred_bin") == j, F.col("n")).otherwise(F.lit(0))).alias(f"pred_bin_{j}")
        for j in range(n_bins)])


def _share(part, whole):
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def bin_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per bin; an empty denominator gives 0."""
    # Each cell feeds its true bin (support) and its predicted bin (predicted).
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("true_bin").alias("bin"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true_bin") == F.col("pred_bin"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("pred_bin").alias("bin"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")))))
    sums = sides.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    hit, support, predicted = F.col("hit"), F.col("support"), F.col("predicted")
    return sums.select(
        "bin",
        _share(hit, predicted).alias("precision"),
        _share(hit, support).alias("recall"),
        _share(2 * hit, predicted + support).alias("f1"),
        "support", "predicted", "hit")


def bin_summary(cells: DataFrame, model: str, n_bins: int) -> DataFrame:
    """Accuracy and averaged F1; the averages run over bins that occur at all."""
    seen = bin_report(cells).where(F.col("support") + F.col("predicted") > 0)
    total = F.sum("support")
    return seen.agg(
        F.lit(model).alias("model"),
        F.lit(n_bins).alias("n_bins"),
        (F.sum("hit") / F.nullif(total, F.lit(0))).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.nullif(total, F.lit(0))).alias("weighted_f1"),
        total.alias("support"))
