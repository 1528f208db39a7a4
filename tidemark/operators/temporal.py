"""Calendar-time splits and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from fractions import Fraction
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import named
from tidemark.sources.tables import DATE

MICROSECOND = timedelta(microseconds=1)
SPLITS = ("train", "val", "test")


def instant(t: datetime) -> Column:
    """A timestamp_ntz literal; folds to a constant the scan can prune with."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def time_range(df: DataFrame, date: str = DATE) -> tuple[datetime, datetime]:
    t = named(date).cast("timestamp_ntz")
    lo, hi = df.agg(F.min(t), F.max(t)).first()
    if lo is None or lo == hi:
        raise ValueError(f"zero time span in {date}")
    return lo, hi


def _at(lo: datetime, hi: datetime, share: Fraction) -> datetime:
    """The instant after ``share`` of the span, in whole microseconds."""
    return lo + round((hi - lo) // MICROSECOND * share) * MICROSECOND


def _in_years(rows: Column, year: str | None, first: datetime | None, last: datetime | None) -> Column:
    """The date predicate with the years it implies."""
    if year is None:
        return rows
    if first is not None:
        rows = rows & (named(year) >= first.year)
    return rows if last is None else rows & (named(year) <= last.year)


def year_column(df: DataFrame) -> str | None:
    return "history_year" if "history_year" in df.columns else None


@dataclass(frozen=True)
class SplitBounds:
    """Train ends at ``cut_train_end``, validation at ``cut_val_end`` (both inclusive)."""

    t_min: datetime
    t_max: datetime
    cut_train_end: datetime
    cut_val_end: datetime

    def rows_of(self, split: str, date: str = DATE, year: str | None = None) -> Column:
        """Date predicate of one split, made of literals so it is pushed down.

        ``year`` names a column with the year of the date; a table partitioned
        by it is then read only where the split has rows.
        """
        d, train_end, val_end = named(date), instant(self.cut_train_end), instant(self.cut_val_end)
        if split == "train":
            return _in_years(d <= train_end, year, None, self.cut_train_end)
        if split == "val":
            return _in_years((d > train_end) & (d <= val_end), year, self.cut_train_end, self.cut_val_end)
        return _in_years(d > val_end, year, self.cut_val_end, None)


def fit_calendar_split(
    df: DataFrame, date: str = DATE, fractions: Sequence[float] = (0.70, 0.10, 0.20)
) -> SplitBounds:
    """Cut points by elapsed time, not by row count."""
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("train/val/test fractions must sum to 1")
    lo, hi = time_range(df, date)
    train, val, _ = (Fraction(str(f)) for f in fractions)
    return SplitBounds(lo, hi, _at(lo, hi, train), _at(lo, hi, train + val))


def assign_split(df: DataFrame, bounds: SplitBounds, date: str = DATE) -> DataFrame:
    d = named(date)
    split = (
        F.when(d <= instant(bounds.cut_train_end), "train")
        .when(d <= instant(bounds.cut_val_end), "val")
        .when(d.isNotNull(), "test"))
    return df.withColumn("split", split)


def calendar_split(
    df: DataFrame, date: str = DATE, fractions: Sequence[float] = (0.70, 0.10, 0.20)
) -> tuple[DataFrame, SplitBounds]:
    bounds = fit_calendar_split(df, date, fractions)
    return assign_split(df, bounds, date), bounds


def split_ranges(df: DataFrame, date: str = DATE) -> DataFrame:
    """One row: first and last date of each split and whether they are in order.

    ``pure`` is false, not NULL, when a split is empty.
    """
    d, s = named(date), F.col("split")
    ranges = df.agg(*[
        f(F.when(s == name, d)).alias(f"{name}_{label}")
        for name in SPLITS for label, f in (("min", F.min), ("max", F.max))])
    ordered = (F.col("train_max") <= F.col("val_min")) & (F.col("val_max") <= F.col("test_min"))
    return ranges.withColumn("pure", F.coalesce(ordered, F.lit(False)))


def assert_temporal_purity(df: DataFrame, date: str = DATE) -> None:
    row = split_ranges(df, date).first()
    empty = [s for s in SPLITS if row[f"{s}_min"] is None]
    if empty:
        raise ValueError(f"empty split: {', '.join(empty)}")
    if not row["pure"]:
        raise ValueError("temporal purity failed: a split starts before the previous one ends")


def bounds_table(spark: SparkSession, bounds: SplitBounds) -> DataFrame:
    names = ("t_min", "t_max", "cut_train_end", "cut_val_end")
    return spark.range(1).select(*[instant(getattr(bounds, n)).alias(n) for n in names])


@dataclass(frozen=True)
class Fold:
    """Train on everything before ``val_start``, validate on [val_start, val_end)."""

    fold: int
    val_start: datetime
    val_end: datetime

    @property
    def label(self) -> str:
        return f"fold_{self.fold}_{self.val_start.date()}_{self.val_end.date()}"

    def train_rows(self, date: str = DATE, year: str | None = None) -> Column:
        return _in_years(named(date) < instant(self.val_start), year, None, self.val_start)

    def val_rows(self, date: str = DATE, year: str | None = None) -> Column:
        rows = (named(date) >= instant(self.val_start)) & (named(date) < instant(self.val_end))
        return _in_years(rows, year, self.val_start, self.val_end)


def walk_forward_folds(df: DataFrame, n: int = 4, date: str = DATE) -> list[Fold]:
    """``n`` expanding folds of equal calendar width."""
    lo, hi = time_range(df, date)
    edge = [_at(lo, hi, Fraction(i, n + 1)) for i in range(n + 2)]
    return [Fold(i, edge[i], edge[i + 1]) for i in range(1, n + 1)]


def folds_table(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    cells = [
        F.struct(F.lit(f.fold).alias("fold"), instant(f.val_start).alias("val_start"),
                 instant(f.val_end).alias("val_end"), F.lit(f.label).alias("label"))
        for f in folds]
    return spark.range(1).select(F.inline(F.array(*cells)))


def fold_members(df: DataFrame, folds: Sequence[Fold], date: str = DATE) -> DataFrame:
    """A copy of each row per fold it takes part in, with its role there.

    The sorted fold starts are one array literal.  A binary search in it gives the number
    of folds that have started at the row's date: the row is in the validation part of
    the last of them, unless that fold has ended, and trains every later fold.  The plan
    is the same for any number of folds, and a narrow projection without a join.  Rows
    without a date are in no fold.  Training loops should rather filter with
    ``Fold.train_rows``.
    """
    folds = sorted(folds, key=lambda f: f.val_start)
    if any(this.val_end > later.val_start for this, later in pairwise(folds)):
        raise ValueError("folds whose validation ranges overlap")
    at = named(date).cast("timestamp_ntz")
    starts, ends = (F.array(*edges).cast("array<timestamp_ntz>") for edges in (
        [instant(f.val_start) for f in folds], [instant(f.val_end) for f in folds]))
    numbers = F.array(*[F.lit(f.fold) for f in folds]).cast("array<int>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(folds).bit_length()))]).cast("array<int>")
    started = F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (n + step <= len(folds)) & (F.get(starts, n + step - 1) <= at), n + step).otherwise(n))

    def roles(n: Column) -> Column:
        val = F.when(F.get(ends, n - 1) > at, F.array(_role(F.get(numbers, n - 1), "val")))
        train = F.when(n < len(folds), F.transform(
            F.sequence(n, F.lit(len(folds) - 1)), lambda i: _role(F.get(numbers, i), "train")))
        none = F.array().cast("array<struct<fold:int,role:string>>")
        return F.concat(F.coalesce(val, none), F.coalesce(train, none))

    met = F.when(at.isNotNull(), F.flatten(F.transform(F.array(started), roles)))
    return df.select("*", F.inline(met))


def _role(fold: Column, role: str) -> Column:
    return F.struct(fold.alias("fold"), F.lit(role).alias("role"))


def fold_support(df: DataFrame, folds: Sequence[Fold], date: str = DATE, min_rows: int = 1000) -> DataFrame:
    """Folds with enough train and validation rows, counted in one pass."""
    wide = df.agg(*[
        F.count_if(rows).alias(f"{role}{f.fold}")
        for f in folds for role, rows in (("t", f.train_rows(date)), ("v", f.val_rows(date)))])
    cells = [
        F.struct(F.lit(f.fold).alias("fold"), F.lit(f.label).alias("label"),
                 F.col(f"t{f.fold}").alias("train_rows"), F.col(f"v{f.fold}").alias("val_rows"))
        for f in folds]
    counts = wide.select(F.inline(F.array(*cells)))
    return counts.where((F.col("train_rows") >= min_rows) & (F.col("val_rows") >= min_rows))
