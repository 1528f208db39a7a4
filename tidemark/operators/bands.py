"""Quantile bands and bins.

Two conventions live side by side and must not be mixed: *bands* are
right-closed with linearly interpolated edges, *bins* are left-closed with
averaged order statistics as edges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import named
from tidemark.functions.quantiles import averaged_inverted_cdf_edges, exact_quantiles

#: Bins narrower than this are merged into their left neighbour.
MIN_BIN_WIDTH = 1e-8
LABEL_DIGITS = 3


def count_where(values: Sequence[float], test) -> Column:
    """How many of a few literal numbers satisfy ``test``."""
    hits = [F.when(test(F.lit(v)), 1).otherwise(0) for v in values]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def fit_band_edges(df: DataFrame, column: str = "y_true", q: int = 5, **options) -> list[float]:
    """Band edges; equal neighbours are merged."""
    found = exact_quantiles(df, {column: [i / q for i in range(q + 1)]}, **options)[column]
    if found[0] is None:
        raise ValueError(f"no values in {column}")
    return sorted(set(found))


def _label_number(x: float, digits: int = LABEL_DIGITS) -> float:
    """Rounded to ``digits`` decimals, or significant digits below one."""
    fraction, whole = math.modf(x)
    if x == 0 or whole:
        return round(x, digits)
    return round(x, digits - 1 - math.floor(math.log10(abs(fraction))))


def band_labels(edges: Sequence[float]) -> list[str]:
    """``(a, b]`` per band; the first is lowered so that it holds the minimum."""
    digits = LABEL_DIGITS
    while len({_label_number(e, digits) for e in edges}) < len(edges) and digits < 20:
        digits += 1
    shown = [_label_number(e, digits) for e in edges]
    shown[0] -= 10.0 ** -digits
    return [f"({a}, {b}]" for a, b in zip(shown, shown[1:])]


def band_index(c: Column, edges: Sequence[float]) -> Column:
    """0-based band of values inside the edges, right-closed."""
    inside = (c >= F.lit(edges[0])) & (c <= F.lit(edges[-1]))
    return F.when(inside, count_where(edges[1:-1], lambda e: e < c))


def assign_bands(
    df: DataFrame, edges: Sequence[float], column: str = "y_true", output: str = "price_band"
) -> DataFrame:
    """The band label of every row as a string column."""
    labels = F.array(*[F.lit(x) for x in band_labels(edges)])
    return df.withColumn(output, F.get(labels, band_index(named(column), edges)))


def fit_bin_edges(df: DataFrame, column: str = "y_true", n_bins: int = 5, **options) -> list[float]:
    """Bin edges without bins that are too narrow; the survivors define the bins."""
    raw = averaged_inverted_cdf_edges(df, column, n_bins, **options)
    return [e for i, e in enumerate(raw) if i == 0 or e - raw[i - 1] > MIN_BIN_WIDTH]


def bin_index(c: Column, edges: Sequence[float]) -> Column:
    """0-based bin, left-closed; values outside fall into the end bins."""
    return F.when(c.isNotNull(), count_where(edges[1:-1], lambda e: e <= c))


def bin_edges_table(spark, edges: Sequence[float]) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "bin_index int, edge_left double, edge_right double")
