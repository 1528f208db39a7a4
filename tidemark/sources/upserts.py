"""Keyed replacement in result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_rows(base: DataFrame | None, new: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Rows of ``new`` replace the rows of ``base`` with the same key."""
    if base is None:
        return new
    kept = base.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def sort_results(results: DataFrame, by: str = "test_rmse") -> DataFrame:
    """Ascending by score; names break ties so the order is stable."""
    return results.orderBy(F.col(by).asc_nulls_last(), "model") if by in results.columns else results


def same_rows(base: DataFrame, new: DataFrame, row_id: str = "row_id") -> bool:
    """Do both prediction tables cover exactly the same rows?"""
    sides = (
        base.select(row_id, F.lit(1).alias("b"), F.lit(0).alias("n"))
        .unionAll(new.select(row_id, F.lit(0).alias("b"), F.lit(1).alias("n"))))
    # Map-side combined on the row id: copies of a row per model collapse early.
    lonely = sides.groupBy(row_id).agg(F.max("b").alias("b"), F.max("n").alias("n")).where("b + n < 2")
    return lonely.isEmpty()


def upsert_predictions(
    base: DataFrame | None, new: DataFrame, model: str = "model", row_id: str = "row_id"
) -> DataFrame:
    """Add or replace the models of ``new``; a stale ``base`` is dropped whole.

    Stale means that the covered rows differ, which catches a changed split
    even when the number of rows happens to agree.
    """
    if base is None or not same_rows(base, new, row_id):
        return new
    # Null-safe: a model without a name is replaced like any other.
    names = new.select(F.col(model).alias("_new_model")).distinct()
    kept = base.join(names, F.col(model).eqNullSafe(F.col("_new_model")), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
