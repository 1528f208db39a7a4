"""From raw rows to the clean table: typing, dedup, clipping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.features import with_features
from tidemark.functions.parsing import double_of, instant_of, named
from tidemark.functions.quantiles import approx_quantiles, exact_medians, exact_quantiles
from tidemark.operators.metrics import regression_metrics
from tidemark.operators.temporal import SplitBounds, assign_split
from tidemark.sources.tables import DATE, TARGET, require_columns
from tidemark.workspace import Workspace

DEDUP_KEY = ("fullAddress", DATE, TARGET)
NUMERIC_SOURCES = ("bedrooms", "bathrooms", "livingRooms", "floorAreaSqM", "latitude", "longitude")


def typed(df: DataFrame, dates: Sequence[str] = (DATE,), numbers: Sequence[str] = (TARGET,)) -> DataFrame:
    """Lenient typing: cells that do not parse become NULL."""
    casts = {c: instant_of(df, c) for c in dates if c in df.columns}
    casts |= {c: double_of(df, c) for c in numbers if c in df.columns}
    return df.withColumns(casts)


def drop_missing(df: DataFrame, columns: Sequence[str] = (DATE, TARGET)) -> DataFrame:
    return df.dropna(subset=["`" + c + "`" for c in columns])


def dedup_keep_first(df: DataFrame, keys: Sequence[str] = DEDUP_KEY, order: str = "row_id") -> DataFrame:
    """First row in input order per key; NULL keys equal each other.

    Catalyst turns the rank filter into a limit per key on both sides of the
    shuffle, so a key with a third of all rows ships one row per map task.
    """
    if any(k not in df.columns for k in keys):
        return df
    first = Window.partitionBy(*[named(k) for k in keys]).orderBy(named(order))
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class ClipBounds:
    """Fitted winsorising limits; None leaves that side open."""

    lo: float | None
    hi: float | None

    def clip(self, c: Column) -> Column:
        if self.lo is not None:
            c = F.greatest(c, F.lit(self.lo))
        return c if self.hi is None else F.least(c, F.lit(self.hi))


NO_CLIP = ClipBounds(None, None)


def fit_quantile_clip(
    df: DataFrame, column: str = TARGET, lo: float = 0.01, hi: float = 0.99,
    accuracy: int | None = None, **options,
) -> ClipBounds:
    """Limits at two quantiles of ``df``; pass only train rows to avoid leakage.

    ``accuracy`` swaps the exact quantiles for a one-pass sketch.
    """
    probs = {column: [lo, hi]}
    found = exact_quantiles(df, probs, **options) if accuracy is None else approx_quantiles(df, probs, accuracy)
    return ClipBounds(*found[column])


def fit_iqr_clip(df: DataFrame, column: str = TARGET, k: float = 1.5, **options) -> ClipBounds:
    """Limits ``k`` interquartile ranges beyond the quartiles."""
    q1, q3 = exact_quantiles(df, {column: [0.25, 0.75]}, **options)[column]
    return NO_CLIP if q1 is None else ClipBounds(q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def apply_clip(
    df: DataFrame, bounds: ClipBounds, column: str = TARGET, where: Column | None = None
) -> DataFrame:
    """Clip ``column``; with ``where`` only the rows it selects."""
    clipped = F.when(named(column).isNotNull(), bounds.clip(named(column)))
    if where is not None:
        clipped = F.when(where, clipped).otherwise(named(column))
    return df.withColumn(column, clipped)


def deduplicated(raw: DataFrame, order: str = "row_id") -> DataFrame:
    """Typed rows with date and target, exact duplicates removed."""
    require_columns(raw, (TARGET, DATE))
    rows = typed(raw, numbers=(TARGET, *NUMERIC_SOURCES))
    return dedup_keep_first(drop_missing(rows), order=order)


def clean_transactions(raw: DataFrame, workspace: Workspace, order: str = "row_id") -> DataFrame:
    """The clean table with clipped target and all row-level features.

    The deduplicated rows are staged, because the clip limits need a pass of
    their own before they can be applied; that pass reads one column.
    """
    rows = workspace.stage(deduplicated(raw, order), "deduplicated")
    bounds = fit_quantile_clip(rows, rows=workspace.rows["deduplicated"])
    return with_features(apply_clip(rows, bounds))


def compare_clip_policies(
    df: DataFrame, policies: Mapping[str, ClipBounds], bounds: SplitBounds, target: str = TARGET
) -> DataFrame:
    """Validation error of the train median under each clipping policy."""
    names = list(policies)
    clipped = assign_split(df, bounds).select(
        "split", *[policies[n].clip(named(target)).alias(f"y{i}") for i, n in enumerate(names)])
    medians = exact_medians(clipped.where("split = 'train'"), [f"y{i}" for i in range(len(names))])
    cells = [
        F.struct(F.lit(n).alias("policy"), F.col(f"y{i}").alias("y_true"),
                 F.lit(medians[f"y{i}"]).alias("y_pred"))
        for i, n in enumerate(names)]
    scored = clipped.where("split = 'val'").select(F.inline(F.array(*cells)))
    return regression_metrics(scored, by=("policy",))
