"""Preprocessing statistics of all expanding folds from one set of states.

The edges of the folds cut the rows into slices.  Each slice is summed up once: rows,
moments of every number, counts of every category.  The train rows of a fold are all slices
before its validation, so its statistics are a running merge of slice states; the cost does
not grow with the number of folds.  Medians don't merge, so the medians of all folds and
columns are selected together in the same few scans (see ``functions.quantiles``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import named
from tidemark.functions.quantiles import exact_medians
from tidemark.operators.policy import FeatureSpec
from tidemark.operators.prep import MAX_CATEGORIES, number_sql
from tidemark.operators.temporal import Fold, instant
from tidemark.sources.tables import DATE
from tidemark.workspace import Workspace


@dataclass(frozen=True)
class Moments:
    """Count, mean and sum of squared deviations; merging keeps them exact up to rounding."""

    n: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * other.n / n, self.squares + other.squares + gap * gap * self.n * other.n / n)


@dataclass
class SliceState:
    rows: int = 0
    numbers: dict[str, Moments] = field(default_factory=dict)
    values: dict[str, Counter] = field(default_factory=dict)

    def merge(self, other: SliceState) -> SliceState:
        numbers = {c: self.numbers.get(c, Moments()).merge(other.numbers.get(c, Moments())) for c in self.numbers | other.numbers}
        values = {c: self.values.get(c, Counter()) + other.values.get(c, Counter()) for c in self.values | other.values}
        return SliceState(self.rows + other.rows, numbers, values)


@dataclass(frozen=True)
class FoldStatistics:
    medians: Mapping[str, float]
    scaler: Mapping[str, tuple[float, float]]
    modes: Mapping[str, str]
    categories: Mapping[str, list[str]]


def slice_number(folds: Sequence[Fold], date: str = DATE) -> Column:
    """How many folds' validation has begun; fold i (from 1) trains on the numbers below i."""
    edges = F.array(*[instant(f.val_start) for f in folds])
    return F.size(F.filter(edges, lambda edge: edge <= named(date).cast("timestamp_ntz")))


def sliced(df: DataFrame, folds: Sequence[Fold], date: str = DATE) -> DataFrame:
    """The train rows of any fold with their ``_slice``."""
    last = max(f.val_start for f in folds)
    return df.where(named(date) < instant(last)).withColumn("_slice", slice_number(folds, date))


def slice_states(
    rows: DataFrame, spec: FeatureSpec, space: Workspace, max_categories: int = MAX_CATEGORIES,
) -> dict[int, SliceState]:
    """State of each slice; two aggregates with one row per slice, or per slice and category."""
    numbers = {c: F.expr(number_sql(c)) for c in spec.numeric}
    sums = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("rows"), *[
        f(x).alias(f"{k}{i}") for i, x in enumerate(numbers.values()) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))])
    states = {}
    for r in sums.collect():
        moments = {c: Moments(r[f"n{i}"], r[f"m{i}"] or 0.0, (r[f"v{i}"] or 0.0) * r[f"n{i}"]) for i, c in enumerate(numbers)}
        states[r["_slice"]] = SliceState(r["rows"], moments)
    if spec.categorical:
        cells = [F.struct(F.lit(c).alias("name"), named(c).cast("string").alias("value")) for c in spec.categorical]
        counts = space.stage(rows.select("_slice", F.inline(F.array(*cells))).where("value IS NOT NULL")
                             .groupBy("_slice", "name", "value").agg(F.count(F.lit(1)).alias("n")), "categories")
        sizes = counts.groupBy("name").agg(F.count_distinct("value").alias("n")).where(F.col("n") > max_categories)
        wide = sorted(r["name"] for r in sizes.collect())
        if wide:
            raise ValueError(f"too many categories for one-hot columns: {', '.join(wide)}")
        for r in counts.collect():
            states[r["_slice"]].values.setdefault(r["name"], Counter())[r["value"]] += r["n"]
    return states


def fold_medians(parts: DataFrame, folds: Sequence[Fold], columns: Sequence[str], **options) -> list[dict[str, float | None]]:
    """Train medians of every fold, all selected together."""
    cells = {f"m_{i}_{k}": (i, c) for i in range(len(folds)) for k, c in enumerate(columns)}
    if not cells:
        return [{} for _ in folds]
    wide = parts.select(*[F.when(F.col("_slice") <= i, F.expr(number_sql(c))).alias(name) for name, (i, c) in cells.items()])
    found = exact_medians(wide, list(cells), **options)
    medians: list[dict] = [{} for _ in folds]
    for name, (i, c) in cells.items():
        medians[i][c] = found[name]
    return medians


def fold_statistics(
    df: DataFrame, folds: Sequence[Fold], spec: FeatureSpec, *, date: str = DATE,
    max_categories: int = MAX_CATEGORIES, rows: int | None = None,
) -> list[FoldStatistics]:
    """What ``fit_preprocessor`` finds on the train rows of each fold, in the order of ``folds``.

    ``rows`` may bound the table's size when the caller knows it.
    """
    folds = sorted(folds, key=lambda f: f.val_start)
    parts = sliced(df, folds, date)
    states = slice_states(parts, spec, Workspace(df.sparkSession), max_categories)
    options = {} if rows is None else {"rows": rows}
    total, found = SliceState(), []
    for i, medians in enumerate(fold_medians(parts, folds, spec.numeric, **options)):
        total = total.merge(states.get(i, SliceState()))
        known = {c: m for c, m in medians.items() if m is not None}
        scaler = {}
        for c, median in known.items():
            own = total.numbers[c]
            filled = own.merge(Moments(total.rows - own.n, median, 0.0))
            scaler[c] = (filled.mean, sqrt(filled.squares / filled.n) or 1.0)
        seen = {c: total.values[c] for c in spec.categorical if total.values.get(c)}
        modes = {c: min(n, key=lambda v, n=n: (-n[v], v)) for c, n in seen.items()}
        found.append(FoldStatistics(known, scaler, modes, {c: sorted(n) for c, n in seen.items()}))
    return found
