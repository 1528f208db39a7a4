"""Scans and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.parsing import NUMBER_PATTERN, missing_to_null, named, parse_number

# Text that a delimited-file reader takes for a truth value.
TRUTH_TOKENS = ["True", "TRUE", "true", "False", "FALSE", "false"]

TARGET = "history_price"
DATE = "history_date"


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Schema contract; checked on metadata, starts no job."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    return df


def with_row_id(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Dense input-order ids for a file scan that has no key of its own.

    Files are ordered by path and blocks by offset; inside a block rows keep
    their order.  One row per block (some 100 MB of input each) is ranked, so
    nothing row-level is sorted or moved.  Persist the result: ids belong to
    one set of files.
    """
    tagged = df.withColumns({
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_seen": F.monotonically_increasing_id(),
    })
    blocks = tagged.groupBy("_file", "_block").agg(F.min("_seen").alias("_first"), F.count("*").alias("_rows"))
    before = F.expr(
        "sum(_rows) OVER (ORDER BY _file, _block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    starts = blocks.select("_file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        tagged.join(starts, ["_file", "_block"])
        .withColumn(row_id, F.col("_before") + F.col("_seen") - F.col("_first"))
        .drop("_file", "_block", "_seen", "_first", "_before"))


def infer_types(df: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Whole-table inference: text that is all numbers or all truth values is typed.

    One aggregate over all columns decides.  A column without any value counts
    as numeric; truth values must not have gaps.  ``evidence`` is a cheaper
    table with the same rows to look at instead.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    counts = (df if evidence is None else evidence).agg(F.count(F.lit(1)), *[
        measure for c in texts for measure in (
            F.count_if(~named(c).rlike(NUMBER_PATTERN)), F.count_if(named(c).isin(TRUTH_TOKENS)))]).first()
    rows, counts = counts[0], counts[1:]
    numeric = {c for i, c in enumerate(texts) if counts[2 * i] == 0}
    truth = {c for i, c in enumerate(texts) if rows and counts[2 * i + 1] == rows}

    def typed(c: str):
        if c in numeric:
            return parse_number(named(c)).alias(c)
        return named(c).cast("boolean").alias(c) if c in truth else named(c)

    return df.select([typed(c) for c in df.columns])


def read_transactions(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    *,
    row_id: str = "row_id",
    infer: bool = False,
    multiline: bool = False,
    required: Sequence[str] = (TARGET, DATE),
) -> DataFrame:
    """Dated transactions from delimited text or Parquet.

    Text columns arrive as strings with the usual missing markers as NULL and
    are typed later by the cleaning operators, so one bad cell cannot fail the
    scan.  ``multiline`` allows line breaks inside quotes, at the price of
    files that cannot be split.
    """
    if fmt == "csv":
        scan = (
            spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path))
        require_columns(scan, required)
        texts = [missing_to_null(named(c)).alias(c) for c in scan.columns if c != row_id]
        keyed = scan.withColumn(row_id, named(row_id).cast("bigint")) if row_id in scan.columns else with_row_id(scan, row_id)
        table = keyed.select(row_id, *texts)
        # The plain scan settles the types, so this pass does not number the rows.
        return infer_types(table, scan.select(texts)) if infer else table
    scan = spark.read.format(fmt).load(path)
    return require_columns(scan, required)


def read_optional(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The Parquet table, or None when it does not exist; other errors surface."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> str:
    """Overwrite one result table; row-level tables keep their partitions."""
    target = f"{root}/{name}"
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(target)
    return target


def write_clean(df: DataFrame, target: str, year: str = "history_year") -> str:
    """Clean table partitioned by year, so later reads prune to their years.

    The rebalance hint gathers a year into few files and lets adaptive
    execution split a year that is far larger than the others.
    """
    df.hint("rebalance", F.col(year)).write.mode("overwrite").partitionBy(year).parquet(target)
    return target


def safe_name(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]+", "_", text)
