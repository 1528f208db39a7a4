"""Run manifest and frozen snapshots of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_optional


def run_manifest(
    spark: SparkSession,
    run_name: str,
    artifacts: Mapping[str, str],
    *,
    target: str = "history_price",
    date_axis: str = "history_date",
    split_policy: str = "calendar_fair_70_10_20_by_time_span",
    primary_metric: str = "test_rmse",
) -> DataFrame:
    """What a run predicted, how it was split and where its tables are."""
    facts = {
        "target": target,
        "date_axis": date_axis,
        "split_policy": split_policy,
        "primary_metric": primary_metric,
        **{f"artifact.{name}": path for name, path in artifacts.items()},
    }
    return spark.createDataFrame(
        [(run_name, k, v) for k, v in facts.items()], "run_name string, key string, value string")


def write_manifest(manifest: DataFrame, path: str) -> str:
    manifest.coalesce(1).write.mode("overwrite").json(path)
    return path


def utc_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H-%M-%SZ")


def publish_snapshot(
    spark: SparkSession, source: str, target: str, names: Sequence[str], stamp: str | None = None
) -> list[str]:
    """Copy the result tables that exist; report which ones were published."""
    stamp = stamp or utc_stamp()
    published = []
    for name in names:
        table = read_optional(spark, source, name)
        if table is not None:
            table.write.mode("overwrite").parquet(f"{target}/run_stamp={stamp}/{name}")
            published.append(name)
    return published


def snapshot_index(spark: SparkSession, published: Sequence[str], stamp: str) -> DataFrame:
    """The published names as a table, for storing next to the snapshot."""
    rows = [(stamp, name) for name in published]
    return spark.createDataFrame(rows, "run_stamp string, name string").withColumn(
        "published", F.lit(len(rows)))
