"""Exploratory profiles: each is one aggregate pass with a tiny result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.parsing import double_of, instant_of, utc_instant_of, named


def _absent(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = named(name)
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def _per_column(df: DataFrame, measure, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column out of a single wide aggregate."""
    columns = list(columns or df.columns)
    wide = df.agg(*[measure(c).alias(f"m{i}") for i, c in enumerate(columns)], F.count("*").alias("rows"))
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"m{i}").alias("measure"),
                 F.col("rows"))
        for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*cells)))


def missing_profile(df: DataFrame, k: int = 20) -> DataFrame:
    """Share of missing values per column, the ``k`` worst first."""
    share = _per_column(df, lambda c: F.count_if(_absent(df, c)))
    return (
        share.select("column_name", (F.lit(100.0) * F.col("measure") / F.col("rows")).alias("missing_pct"))
        .orderBy(F.desc("missing_pct"), "column_name").limit(k))


def schema_profile(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of every column."""
    types = F.element_at(
        F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))]),
        F.col("column_name"))
    counts = _per_column(df, lambda c: F.count_if(~_absent(df, c)))
    return counts.select(
        "position", "column_name", types.alias("dtype"), F.col("measure").alias("non_null"), "rows")


def date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null and distinct counts with the UTC range of each date column present."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "column_name string, non_null bigint, distinct_values bigint, min_date timestamp_ntz, max_date timestamp_ntz")
    cells = [F.struct(F.lit(c).alias("column_name"), utc_instant_of(df, c).alias("t")) for c in present]
    # Counting per value first combines copies before the shuffle and avoids
    # the row expansion of several count-distincts in one aggregate.
    values = df.select(F.inline(F.array(*cells))).groupBy("column_name", "t").agg(F.count("*").alias("n"))
    return values.groupBy("column_name").agg(
        F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("non_null"),
        F.count("t").alias("distinct_values"),
        F.min("t").alias("min_date"),
        F.max("t").alias("max_date"))


def coverage(df: DataFrame, date: str = "history_date", target: str = "history_price") -> DataFrame:
    """Rows that carry both a date and a target, of all rows."""
    both = instant_of(df, date).isNotNull() & ~_absent(df, target)
    return df.agg(F.count_if(both).alias("rows_with_both"), F.count("*").alias("total_rows"))


def distinct_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    c = named(column)
    measure = F.approx_count_distinct(c) if approximate else F.countDistinct(c)
    return df.agg(measure.alias("distinct_values"))


def duplicate_membership(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that share their key with another row, and rows a dedup removes."""
    groups = df.groupBy(*[named(k) for k in keys]).agg(F.count("*").alias("n"))
    total = F.sum("n")
    member = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
    return groups.agg(
        F.coalesce(total, F.lit(0)).alias("total_rows"),
        member.alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable_rows"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width counts over the value range; the last bin is closed.

    Every bin is present, also the empty ones.
    """
    values = df.select(value.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, edge_left double, edge_right double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    bin_of = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    i = F.col("bin")
    return (
        spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        .join(counts, "bin", "left")
        .select("bin", (F.lit(lo) + i * F.lit(width)).alias("edge_left"),
                (F.lit(lo) + (i + 1) * F.lit(width)).alias("edge_right"),
                F.coalesce("n", F.lit(0)).alias("n")))


def log_histogram(df: DataFrame, target: str = "history_price", bins: int = 50) -> DataFrame:
    return histogram(df, F.log1p(double_of(df, target)), bins)


def split_profile(df: DataFrame, split: str = "split") -> DataFrame:
    """Row count and row share of each split."""
    names = ("train", "val", "test")
    s = named(split)
    wide = df.agg(F.count("*").alias("total"), *[F.count_if(s == n).alias(n) for n in names])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("split"), F.col(n).alias("n_rows"), F.col("total")) for n in names])))
    share = F.round(F.lit(100.0) * F.col("n_rows") / F.col("total"), 2)
    return rows.select("split", "n_rows", share.alias("row_pct"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
