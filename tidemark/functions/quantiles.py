"""Exact quantiles and order statistics that hold at any row count.

Spark's ``percentile`` keeps a value-to-count map per group in one task, which
is the fastest exact answer while that map is small.  Its size is therefore
checked first.  Beyond the limit the same numbers come from distributed
selection: a bounded sketch proposes cut points, one map-side combined count
per cell says which cell holds each wanted rank, and only those cells are
looked at again.  A value with any number of copies gets a cell of its own, so
ties and hot values cost nothing extra and the result stays exact.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parsing import named

#: Cells (rows x columns) up to which one ``percentile`` aggregate is used.
BUILTIN_CELLS = 4_000_000
#: Distinct values that may be resolved on the driver.
LEAF_ROWS = 100_000
#: Cut points proposed per round, over all intervals still open.
CUT_BUDGET = 20_000


@dataclass(frozen=True)
class _Open:
    """Values of one column in [lo, hi] that still hide wanted ranks."""

    column: int
    lo: float
    hi: float
    below: int
    rows: int
    ranks: tuple[int, ...]


def _after(x: float) -> float:
    return float(np.nextafter(x, math.inf))


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles ``v0, v1, ...`` with NaN as NULL and -0.0 as 0.0."""
    values = [F.nanvl(named(c).cast("double"), F.lit(None).cast("double")) + F.lit(0.0) for c in columns]
    return df.select([v.alias(f"v{i}") for i, v in enumerate(values)])


def _long(df: DataFrame, columns: Sequence[int], binned: bool = False) -> DataFrame:
    """(k, v[, b]) rows; pipelined into the aggregate above it, never shuffled."""
    fields = [
        F.struct(
            F.lit(i).alias("k"), F.col(f"v{i}").alias("v"),
            *([F.col(f"b{i}").cast("int").alias("b")] if binned else []))
        for i in columns
    ]
    return df.select(F.inline(F.array(*fields))).where(F.col("v").isNotNull())


def _binned(df: DataFrame, cuts: Mapping[int, Sequence[float]]) -> DataFrame:
    """Rows tagged with b = number of cuts at or below the value."""
    columns = sorted(cuts)
    bucketizer = Bucketizer(
        splitsArray=[[-math.inf, *cuts[i], math.inf] for i in columns],
        inputCols=[f"v{i}" for i in columns],
        outputCols=[f"b{i}" for i in columns],
        handleInvalid="keep",
    )
    return _long(bucketizer.transform(df), columns, binned=True)


def _cut_points(values: Mapping[int, Iterable[float]]) -> dict[int, list[float]]:
    """Sorted finite cuts per column; Bucketizer wants at least one."""
    return {k: sorted({x for x in vs if math.isfinite(x)}) or [0.0] for k, vs in values.items()}


def _inside(tagged: DataFrame, opened: Sequence[_Open], cuts: Mapping[int, Sequence[float]]) -> DataFrame:
    """Only rows of the open intervals; ``cuts`` must contain their ends."""
    wanted = defaultdict(list)
    for o in opened:
        wanted[o.column].append(cuts[o.column].index(o.lo) + 1 if math.isfinite(o.lo) else 0)
    keep = F.lit(False)
    for k, bins in wanted.items():
        keep = keep | ((F.col("k") == k) & F.col("b").isin(sorted(set(bins))))
    return tagged.where(keep)


def _ends(opened: Sequence[_Open]) -> dict[int, list[float]]:
    ends = defaultdict(set)
    for o in opened:
        ends[o.column] |= {o.lo, _after(o.hi)}
    return _cut_points(ends)


def _grid(n_open: int) -> list[float]:
    """Probabilities at which each open interval is cut in the next round."""
    parts = max(2, min(512, CUT_BUDGET // n_open))
    return [i / parts for i in range(parts + 1)]


def _sketch(probs: Sequence[float]):
    return F.percentile_approx("v", list(probs), 4 * len(probs)).alias("cuts")


def _propose(df: DataFrame, opened: Sequence[_Open]) -> dict[int, list[float]]:
    """Approximate quantiles inside each open interval, per column."""
    ends = _ends(opened)
    inside = _inside(_binned(df, ends), opened, ends)
    proposed = {k: list(v) for k, v in ends.items()}
    for row in inside.groupBy("k", "b").agg(_sketch(_grid(len(opened)))).collect():
        proposed[row.k] += row.cuts
    return proposed


def _narrow(
    df: DataFrame, opened: Sequence[_Open], proposed: Mapping[int, Sequence[float]],
    found: dict[int, dict[int, float]],
) -> list[_Open]:
    """Count the cells between the proposed cuts; keep those that hold ranks."""
    # [x, next(x)) is a cell of its own: copies of x are settled at once.
    cuts = _cut_points({k: [y for x in xs for y in (x, _after(x))] for k, xs in proposed.items()})
    cells = defaultdict(list)
    for row in _binned(df, cuts).groupBy("k", "b").agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
        cells[row.k].append(row)

    still = []
    for k, rows in cells.items():
        rows.sort(key=lambda r: r.b)
        starts = np.cumsum([0] + [r.n for r in rows])
        by_cell = defaultdict(list)
        for rank in (r for o in opened if o.column == k for r in o.ranks):
            by_cell[int(np.searchsorted(starts, rank, side="right")) - 1].append(rank)
        for cell, ranks in by_cell.items():
            row = rows[cell]
            still.append(_Open(k, row.lo, row.hi, int(starts[cell]), row.n, tuple(ranks)))
    return _settle(still, found)


def _settle(opened: Iterable[_Open], found: dict[int, dict[int, float]]) -> list[_Open]:
    """Answer intervals that hold a single value; return the rest."""
    rest = []
    for o in opened:
        if o.lo == o.hi:
            found[o.column].update(dict.fromkeys(o.ranks, o.lo))
        else:
            rest.append(o)
    return rest


def _leaf(df: DataFrame, opened: Sequence[_Open], found: dict[int, dict[int, float]]) -> None:
    """Few enough rows remain: count each distinct value and read ranks off."""
    ends = _ends(opened)
    values = defaultdict(list)
    for row in _inside(_binned(df, ends), opened, ends).groupBy("k", "v").count().collect():
        values[row["k"]].append((row["v"], row["count"]))
    for k in values:
        values[k].sort()
    for o in opened:
        members = [(v, n) for v, n in values[o.column] if o.lo <= v <= o.hi]
        last = o.below + np.cumsum([n for _, n in members])
        for rank in o.ranks:
            found[o.column][rank] = members[int(np.searchsorted(last, rank, side="right"))][0]


def _select(
    df: DataFrame, columns: Sequence[str], wanted: Callable[[str, int], Iterable[int]], leaf_rows: int
) -> tuple[dict[str, dict[int, float]], dict[str, int]]:
    """Order statistics at ``wanted(column, count)``, and the counts.

    One pass counts and sketches, one counts cells; every further round is
    two more passes over a few cells in a thousand.
    """
    df = _numbers(df, columns)
    found: dict[int, dict[int, float]] = defaultdict(dict)
    first = _long(df, range(len(columns))).groupBy("k").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), _sketch(_grid(len(columns))))
    opened, proposed, counts = [], {}, dict.fromkeys(columns, 0)
    for row in first.collect():
        name = columns[row.k]
        counts[name] = row.n
        ranks = tuple(sorted(set(wanted(name, row.n))))
        if ranks and not 0 <= ranks[0] <= ranks[-1] < row.n:
            raise ValueError(f"rank out of range for {name}: {row.n} values")
        if ranks:
            opened.append(_Open(row.k, row.lo, row.hi, 0, row.n, ranks))
            proposed[row.k] = [row.lo, row.hi, *row.cuts]
    opened = _settle(opened, found)
    while opened and sum(o.rows for o in opened) > leaf_rows:
        proposed = {k: proposed[k] for k in {o.column for o in opened}} if proposed else _propose(df, opened)
        opened, proposed = _narrow(df, opened, proposed, found), {}
    if opened:
        _leaf(df, opened, found)
    return {c: dict(found[i]) for i, c in enumerate(columns)}, counts


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], *, leaf_rows: int = LEAF_ROWS
) -> dict[str, dict[int, float]]:
    """Exact 0-based order statistics of numeric columns, NULL and NaN left out."""
    return _select(df, list(ranks), lambda name, _: ranks[name], leaf_rows)[0] if ranks else {}


def _linear(stats: Mapping[int, float], n: int, p: float) -> float:
    position = p * (n - 1)
    low, high = math.floor(position), math.ceil(position)
    if low == high or stats[low] == stats[high]:
        return stats[low]
    return (high - position) * stats[low] + (position - low) * stats[high]


def exact_quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    *,
    rows: int | None = None,
    builtin_cells: int = BUILTIN_CELLS,
    leaf_rows: int = LEAF_ROWS,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; None for an empty column.

    ``rows`` is an upper bound of the row count when the caller knows it.
    """
    if not probs:
        return {}
    columns = list(probs)
    rows = df.count() if rows is None else rows
    if rows * len(columns) <= builtin_cells:
        numbers = _numbers(df, columns)
        found = numbers.agg(*[
            F.percentile(f"v{i}", F.array(*[F.lit(float(p)) for p in probs[c]])).alias(f"q{i}")
            for i, c in enumerate(columns)]).first()
        return {c: list(found[i]) if found[i] is not None else [None] * len(probs[c])
                for i, c in enumerate(columns)}

    def wanted(name: str, n: int) -> list[int]:
        positions = [p * (n - 1) for p in probs[name]]
        return [r for x in positions for r in (math.floor(x), math.ceil(x))]

    stats, counts = _select(df, columns, wanted, leaf_rows)
    return {c: [_linear(stats[c], counts[c], p) if counts[c] else None for p in probs[c]] for c in columns}


def approx_quantiles(
    df: DataFrame, probs: Mapping[str, Sequence[float]], accuracy: int
) -> dict[str, list[float | None]]:
    """One-pass sketch for callers that accept a rank error of rows/accuracy."""
    columns = list(probs)
    found = _numbers(df, columns).agg(*[
        F.percentile_approx(f"v{i}", [float(p) for p in probs[c]], accuracy)
        for i, c in enumerate(columns)]).first()
    return {c: list(found[i]) if found[i] is not None else [None] * len(probs[c])
            for i, c in enumerate(columns)}


def exact_medians(df: DataFrame, columns: Sequence[str], **options) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, {c: [0.5] for c in columns}, **options).items()}


def averaged_inverted_cdf_edges(
    df: DataFrame, column: str, parts: int, *, leaf_rows: int = LEAF_ROWS
) -> list[float]:
    """Edges of ``parts`` equal-count bins; a cut between two values averages them.

    The split position i*n/parts is tested with integers, because n*q in
    floating point misses exact hits.
    """
    def pairs(n: int) -> list[tuple[int, int]]:
        cuts = [divmod(i * n, parts) for i in range(parts + 1)]
        return [(max(j - 1, 0), min(j, n - 1)) if rest == 0 else (j, j) for j, rest in cuts]

    stats, counts = _select(df, [column], lambda _, n: [r for p in pairs(n) for r in p], leaf_rows)
    if not counts[column]:
        raise ValueError(f"no values in {column}")
    return [(stats[column][a] + stats[column][b]) / 2 for a, b in pairs(counts[column])]
